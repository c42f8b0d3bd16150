"""Density clusters of map points over a ladder of distance thresholds.

After Campello, Moulavi and Sander (2013), with the hierarchy taken at a fixed
number of levels instead of at every merge: at each threshold the connected
components of the mutual-reachability graph are found, components below the
minimum size are noise, and the nested components form the cluster tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.operators.bags import number_rows
from telemap.operators.maps import valid_points
from telemap.operators.neighbors import knn_plane
from telemap.session import cut

MIN_SIZE = 10
LEVELS = 10


def reachability_edges(points: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Mutual-reachability edges ``(a, b, w)`` among nearest neighbours."""
    knn = cut(knn_plane(points, min_size))
    core = knn.groupBy("id").agg(F.max("dist").alias("core"))
    pairs = knn.select(
        F.least("id", "neighbor").alias("a"), F.greatest("id", "neighbor").alias("b"), "dist"
    ).distinct()
    ca = core.select(F.col("id").alias("a"), F.col("core").alias("core_a"))
    cb = core.select(F.col("id").alias("b"), F.col("core").alias("core_b"))
    return pairs.join(ca, "a").join(cb, "b").select(
        "a", "b", F.greatest("dist", "core_a", "core_b").alias("w")
    )


def thresholds(edges: DataFrame, levels: int = LEVELS) -> list[float]:
    """Ascending edge-weight quantiles, the last one keeping every edge."""
    shares = [(i + 1) / levels for i in range(levels)]
    cuts = edges.agg(F.percentile_approx("w", shares, 10_000).alias("q")).first()["q"] or []
    return sorted(set(cuts))


def components(edges: DataFrame) -> DataFrame:
    """Connected components ``(v, c)`` of ``(a, b)`` edges, named by their least vertex.

    Every round a vertex takes the least label among its neighbours and then its
    label's label, which halves the distance to the root.
    """
    both = cut(
        edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(
            edges.select(F.col("b").alias("v"), F.col("a").alias("u"))
        ).distinct()
    )
    labels = cut(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("c")))
    while True:
        around = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u")
        least = around.groupBy("v").agg(F.min("cu").alias("m"))
        lower = labels.join(least, "v").select(
            "v", F.col("c").alias("old"), F.least("c", "m").alias("c")
        )
        roots = lower.select(F.col("v").alias("c"), F.col("c").alias("root"))
        jumped = cut(
            lower.join(roots, "c").select(
                "v", F.least("c", "root").alias("c"), "old"
            )
        )
        changed = not jumped.filter(F.col("c") != F.col("old")).isEmpty()
        labels = jumped.select("v", "c")
        if not changed:
            return labels


def _ladder(points: DataFrame, edges: DataFrame, cuts: list[float]):
    """Components per level as a merge tree over nodes.

    Returns ``(finest, nodes)``: the finest component of every point, and per
    level ``(comp, size, parent)`` with the parent one level up.  The graph is
    contracted from level to level, so coarse levels are small.
    """
    finest = points.select("id", F.col("id").alias("comp"))
    sizes = finest.select("comp", F.lit(1).cast("long").alias("size"))
    nodes = []
    for i, limit in enumerate(cuts):
        near = edges.filter(F.col("w") <= limit)
        merged = components(near) if not near.isEmpty() else None
        if merged is None:
            named = sizes.withColumn("up", F.col("comp"))
        else:
            named = sizes.join(merged, sizes.comp == merged.v, "left").select(
                "comp", "size", F.coalesce("c", "comp").alias("up")
            )
        named = cut(named)
        if i == 0:
            finest = cut(
                finest.join(named.select("comp", "up"), "comp").select("id", F.col("up").alias("comp"))
            )
        else:
            nodes.append(named.select("comp", "size", F.col("up").alias("parent")))
        sizes = named.groupBy(F.col("up").alias("comp")).agg(F.sum("size").alias("size"))
        up = named.select("comp", "up")
        edges = cut(
            edges.filter(F.col("w") > limit)
            .join(up.select(F.col("comp").alias("a"), F.col("up").alias("ua")), "a")
            .join(up.select(F.col("comp").alias("b"), F.col("up").alias("ub")), "b")
            .filter("ua <> ub")
            .groupBy(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .agg(F.min("w").alias("w"))
        )
    nodes.append(
        sizes.select("comp", "size", F.lit(None).cast(sizes.schema["comp"].dataType).alias("parent"))
    )
    return finest, nodes


def density_clusters(
    points: DataFrame, min_size: int = MIN_SIZE, levels: int = LEVELS, select: str = "eom"
) -> DataFrame:
    """Clusters ``(id, cluster)`` of placed points; -1 is noise.

    ``select`` is ``"eom"`` for the most stable clusters or ``"leaf"`` for the
    finest ones.
    """
    if select not in ("eom", "leaf"):
        raise ValueError("select must be 'eom' or 'leaf'")
    placed = cut(valid_points(points).select("id", "x", "y"))
    edges = cut(reachability_edges(placed, min_size))
    cuts = thresholds(edges, levels)
    if not cuts:
        return placed.select("id", F.lit(-1).alias("cluster"))
    finest, nodes = _ladder(placed, edges, cuts)
    tree, paths = _condense(finest, nodes, cuts, min_size)
    chosen = _leaves(tree) if select == "leaf" else _most_stable(tree, len(nodes))
    numbered = number_rows(chosen.select("key").distinct().orderBy("key"), "cluster")
    found = (
        paths.select("id", F.explode("keys").alias("key"))
        .join(numbered, "key")
        .groupBy("id")
        .agg(F.min("cluster").cast("int").alias("cluster"))
    )
    return placed.select("id").join(found, "id", "left").select(
        "id", F.coalesce("cluster", F.lit(-1)).alias("cluster")
    )


def _condense(finest: DataFrame, nodes: list[DataFrame], cuts: list[float], min_size: int):
    """Chains of big components between splits.

    Going down from the coarsest level, a component with one big child goes on as
    the same cluster, with several it ends and each child starts a cluster.
    Returns the clusters ``(key, above, birth, stability, ended)`` and per point
    the keys of all clusters it was ever in.
    """
    top = len(nodes) - 1
    steps = [1.0 / max(c, 1e-12) for c in cuts]
    level = nodes[top].filter(F.col("size") >= min_size)
    key = F.concat(F.lit(f"{top:03d}|"), F.col("comp").cast("string"))
    null_key = F.lit(None).cast("string")
    level = cut(level.select("comp", "size", key.alias("key"), null_key.alias("above"), F.lit(top).alias("birth")))
    chains = []
    keys = {top: level.select("comp", F.array("key").alias("keys"))}
    known = keys[top]
    for i in range(top, -1, -1):
        # At this level a chain is known to live from the next threshold up to its own.
        upper = steps[i] - (steps[i + 1] if i < top else steps[i])
        if i == 0:
            chains.append(
                level.select("key", "above", "birth", (F.col("size") * upper).alias("s"), F.lit(0).alias("kids"))
            )
            break
        big = nodes[i - 1].filter(F.col("size") >= min_size)
        kids = big.groupBy(F.col("parent").alias("comp")).agg(F.count(F.lit(1)).alias("kids"))
        here = cut(level.join(kids, "comp", "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
        chains.append(
            here.select("key", "above", "birth", (F.col("size") * upper).alias("s"), "kids")
        )
        new = F.concat(F.lit(f"{i - 1:03d}|"), big["comp"].cast("string"))
        splits = F.col("kids") > 1
        level = cut(
            big.join(
                here.select(
                    F.col("comp").alias("parent"), F.col("key").alias("k"), F.col("above").alias("a"),
                    F.col("birth").alias("b"), "kids",
                ),
                "parent",
            ).select(
                "comp",
                "size",
                F.when(splits, new).otherwise(F.col("k")).alias("key"),
                F.when(splits, F.col("k")).otherwise(F.col("a")).alias("above"),
                F.when(splits, F.lit(i - 1)).otherwise(F.col("b")).alias("birth"),
            )
        )
        # Keys of every component of the next level down: its parent's and its own.
        down = (
            nodes[i - 1]
            .select("comp", "parent")
            .join(known.select(F.col("comp").alias("parent"), "keys"), "parent", "left")
            .join(level.select("comp", "key"), "comp", "left")
        )
        known = cut(
            down.select(
                "comp",
                F.array_distinct(
                    F.concat(
                        F.coalesce("keys", F.array().cast("array<string>")),
                        F.array_compact(F.array("key")),
                    )
                ).alias("keys"),
            )
        )
    all_chains = chains[0]
    for more in chains[1:]:
        all_chains = all_chains.unionByName(more)
    tree = cut(
        all_chains.groupBy("key").agg(
            F.first("above").alias("above"),
            F.first("birth").alias("birth"),
            F.sum("s").alias("stability"),
            F.max("kids").alias("kids"),
        )
    )
    paths = finest.join(known, "comp").select("id", "keys")
    return tree, paths


def _leaves(tree: DataFrame) -> DataFrame:
    return tree.filter("kids < 2").select("key")


def _most_stable(tree: DataFrame, levels: int) -> DataFrame:
    """Clusters more stable than all clusters inside them together.

    A single top cluster that splits holds everything and is not an answer.
    """
    tops = tree.filter(F.col("above").isNull())
    only = tops.limit(2).count() == 1
    barred = F.col("above").isNull() & (F.col("kids") > 1) if only else F.lit(False)
    best = None
    for birth in range(levels):
        mine = tree.filter(F.col("birth") == birth)
        if best is None:
            scored = mine.withColumn("inner", F.lit(0.0))
        else:
            inside = best.filter(F.col("above").isNotNull()).groupBy(F.col("above").alias("key")).agg(
                F.sum("score").alias("inner")
            )
            scored = mine.join(inside, "key", "left").withColumn(
                "inner", F.coalesce("inner", F.lit(0.0))
            )
        wins = ((F.col("kids") < 2) | (F.col("stability") >= F.col("inner"))) & ~barred
        scored = scored.select(
            "key",
            "above",
            "birth",
            wins.alias("wins"),
            F.when(wins, F.greatest("stability", "inner")).otherwise(F.col("inner")).alias("score"),
        )
        best = cut(scored if best is None else best.unionByName(scored))
    # From the top down, everything under a winner is out.
    open_ = best.filter(F.col("above").isNull())
    chosen = None
    for _ in range(levels):
        won = open_.filter("wins").select("key")
        chosen = won if chosen is None else chosen.unionByName(won)
        lost = open_.filter("NOT wins").select(F.col("key").alias("above"))
        open_ = cut(best.join(lost, "above", "left_semi"))
        if open_.isEmpty():
            break
    return cut(chosen)

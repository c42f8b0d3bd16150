"""Whole studies, stage by stage: each returns its results as named DataFrames.

Stages hand over through ``cut`` tables, so a stage is computed once however many
later ones read it.  ``save`` writes any result set with the sinks of
``telemap.sources``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.functions.text import args_of, hover_text, host_time_text, tokenize
from telemap.operators import (
    bags,
    cluster,
    cooccurrence,
    hosttime,
    labels,
    layout,
    maps,
    reduce,
    transport,
    weights,
)
from telemap.session import cut
from telemap.sources import save_stage

Results = dict[str, DataFrame]


@dataclass
class Options:
    """Sizes of a study; the defaults follow published practice where known."""

    vector_width: int = 512
    cloud: int = transport.CLOUD
    embedding_width: int = transport.WIDTH
    neighbors: int = layout.NEIGHBORS
    epochs: int = layout.EPOCHS
    smoothing: int = 3
    top_labels: int = 25
    min_cluster: int = cluster.MIN_SIZE
    levels: int = cluster.LEVELS


def _weigh(bag: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The weighted bag, and the ids of all rows, with or without a column that has bits."""
    bag = cut(bag)
    ids = cut(bag.select(F.col("row_id").alias("id")).distinct())
    return cut(weights.reweight(bag, weights.information_weights(bag), drop_zero=True)), ids


def _every(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Results for every id; a row that no column tells apart has null vector and place."""
    return cut(ids.join(found, "id", "left"))


def _sound(faults: DataFrame, message: str) -> None:
    """Raise with a few examples if a check found anything."""
    some = faults.limit(3).collect()
    if some:
        raise ValueError(f"{message}: {some}")


def command_lines(processes: DataFrame, opts: Options | None = None) -> Results:
    """Unique command lines as bags of tokens: weights, Hellinger map, annotations."""
    opts = opts or Options()
    uniq = cut(bags.uniques(processes, "cmdline", "pid_hash", ["timestamp", "hostname"]))
    _sound(bags.clashing_ids(uniq), "object ids collide")
    tokens = cut(tokenize(uniq, "obj").select("obj_id", "tokens").filter("tokens IS NOT NULL"))
    wbag, _ = _weigh(bags.bag(tokens, "obj_id", "tokens"))
    ids = uniq.select(F.col("obj_id").alias("id"))
    points = _every(ids, layout.map_bags(wbag, opts.neighbors, opts.epochs))

    top = cut(bags.top_values(processes, "name", opts.top_labels))
    firsts = uniq.join(
        processes.select(F.col("pid_hash").alias("first_key"), "name"), "first_key"
    )
    notes = bags.bucket_labels(firsts, "name", top).select(
        F.col("obj_id").alias("id"),
        "label",
        hover_text(F.col("n"), F.col("obj")).alias("hover_text"),
    )
    dictionary = maps.label_dictionary(top, "name")
    return {
        "uniques": uniq,
        "tokens": tokens,
        "weighted_bag": wbag,
        "map": points,
        "annotations": cut(notes),
        "dictionary": dictionary,
        "map_table": maps.map_table(points, notes, notes),
    }


def command_line_vectors(study: Results, opts: Options | None = None) -> Results:
    """Command lines as distributions over token vectors, and their cosine map."""
    opts = opts or Options()
    table = cut(cooccurrence.smooth_cooccurrence(study["tokens"], n_iter=opts.smoothing))
    every = study["tokens"].select(F.explode("tokens").alias("token"))
    tokens = cut(reduce.token_vectors(table, opts.vector_width, every))
    found = cut(
        transport.transport_embedding(
            study["weighted_bag"], tokens, opts.cloud, opts.embedding_width
        )
    )
    ids = study["uniques"].select(F.col("obj_id").alias("id"))
    vectors = _every(ids, found)
    points = _every(ids, layout.map_vectors(found, opts.neighbors, opts.epochs))
    return {
        "token_vectors": tokens,
        "token_map": layout.map_vectors(tokens, opts.neighbors, opts.epochs),
        "vectors": vectors,
        "map": points,
        "map_table": maps.map_table(points, study["annotations"], study["annotations"]),
    }


def image_loads(processes: DataFrame, loads: DataFrame, opts: Options | None = None) -> Results:
    """Processes as bags of loaded images: vectors, map, clusters and topics."""
    opts = opts or Options()
    _sound(bags.multiplied_rows(processes), "processes come twice")
    wbag, ids = _weigh(bags.bag_of_pairs(loads, "pid_hash", "filename"))
    items = cut(reduce.item_vectors(wbag, opts.vector_width))
    placed = cut(transport.transport_embedding(wbag, items, opts.cloud, opts.embedding_width))
    vectors = _every(ids, placed)
    points = _every(ids, layout.map_vectors(placed, opts.neighbors, opts.epochs))
    found = cut(cluster.density_clusters(points, opts.min_cluster, opts.levels))
    topics = labels.cluster_topics(wbag, found)
    named = maps.label_points(found, topics)
    hover = processes.select(
        F.col("pid_hash").alias("id"),
        args_of(F.col("cmdline"), F.col("name")).alias("hover_text"),
    )
    return {
        "weighted_bag": wbag,
        "item_vectors": items,
        "vectors": vectors,
        "map": points,
        "clusters": found,
        "topics": topics,
        "map_table": maps.map_table(points, named, hover),
    }


def host_times(
    processes: DataFrame,
    cmdline_vectors: DataFrame,
    opts: Options | None = None,
    origin: str = hosttime.BIN_ORIGIN,
    reject_before_origin: bool = False,
) -> Results:
    """Hosts over time as distributions over command-line vectors, with workload labels."""
    opts = opts or Options()
    binned = hosttime.time_bin(
        processes.withColumn("obj_id", bags.object_id(F.col("cmdline"))),
        origin=origin,
        reject_before_origin=reject_before_origin,
    )
    instances = cut(
        binned.filter(F.col("cmdline").isNotNull()).withColumn(
            "row_id", hosttime.host_time_id(F.col("hostname"), F.col("bin"))
        )
    )
    edges = instances.select("row_id", "obj_id", F.lit(1).alias("n"))
    columns = cmdline_vectors.select(F.col("id").alias("col_id"))
    wbag, ids = _weigh(bags.edges_to_bag(edges, ["row_id"], "obj_id", "n", columns))
    known = cmdline_vectors.filter(F.col("vec").isNotNull())
    placed = cut(transport.lift(wbag, known, n_ref=opts.cloud, dim=opts.embedding_width))
    vectors = _every(ids, placed)
    points = _every(ids, layout.map_vectors(placed, opts.neighbors, opts.epochs))
    found = cut(cluster.density_clusters(points, opts.min_cluster, opts.levels, select="leaf"))
    bits = labels.cluster_bits(wbag, found.filter("cluster >= 0"))
    members = labels.cluster_members(instances, found)
    _sound(labels.unmatched_bits(bits, members), "objects of a cluster that none of its members ran")
    names = labels.workload_labels(wbag, found, instances)
    rows = instances.select(F.col("row_id").alias("id"), "hostname", "bin").distinct()
    hover = rows.select("id", host_time_text(F.col("hostname"), F.col("bin")).alias("hover_text"))
    colour = hosttime.time_fraction(rows, out="colour")
    return {
        "weighted_bag": wbag,
        "vectors": vectors,
        "map": points,
        "clusters": found,
        "labels": names,
        "paths": hosttime.host_path(rows.join(points, "id")),
        "map_table": maps.map_table(points, maps.label_points(found, names), hover, colour),
    }


def comparison(study: Results, vectors: DataFrame, opts: Options | None = None) -> DataFrame:
    """The vector map started at the bag map and aligned to it, side by side."""
    opts = opts or Options()
    base = maps.valid_points(study["map"])
    kept = vectors.filter(F.col("vec").isNotNull()).join(base.select("id"), "id", "left_semi")
    warm = layout.map_vectors(kept, opts.neighbors, opts.epochs, start=base)
    return maps.compare_maps(base, warm, study["annotations"])


def save(results: Results, folder: str) -> None:
    for name, df in results.items():
        save_stage(df, f"{folder.rstrip('/')}/{name}")

"""What sets clusters apart: column shares, topics, workload names, label anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemap.functions.text import (
    UNLABELLED,
    base_name,
    bits_text,
    gap_sign,
    join_lines,
    unique_label,
)
from telemap.operators.bags import number_rows
from telemap.session import cut

# Fixed values of the label rules: names per label, columns per topic, the least
# bits an object and a name must have, and how far below the best name may lie.
NAMES_PER_LABEL = 3
ITEMS_PER_TOPIC = 3
OBJECT_BITS = 1e-6
NAME_BITS = 1.0
NAME_RATIO = 10.0

# Gaps are compared at this precision so that ties break by name, not by the
# order in which partial sums arrived.
RANK_DIGITS = 9


def of_cluster(df: DataFrame, cluster: int) -> DataFrame:
    return df.filter(F.col("cluster") == cluster)


def num_clusters(clusters: DataFrame) -> DataFrame:
    """Number of clusters, noise not counted."""
    return clusters.filter("cluster >= 0").select("cluster").distinct().agg(
        F.count(F.lit(1)).alias("n_clusters")
    )


def cluster_bits(wbag: DataFrame, clusters: DataFrame, row: str = "row_id") -> DataFrame:
    """Column totals per cluster."""
    return (
        wbag.join(clusters.select(F.col("id").alias(row), "cluster"), row)
        .groupBy("cluster", "col_id")
        .agg(F.sum("w").alias("bits"))
    )


def col_distribution(totals: DataFrame, by: str | None = None, value: str = "bits") -> DataFrame:
    """Column totals to shares, over everything or per ``by``.

    Sums per group come from an aggregate and a join, not a window, so a cluster
    that holds most columns is never gathered in one task.
    """
    if by is None:
        whole = totals.agg(F.sum(value).alias("s")).scalar()
        return totals.select("col_id", (F.col(value) / whole).alias("share"))
    sums = totals.groupBy(by).agg(F.sum(value).alias("_s"))
    return totals.join(sums, by).select(by, "col_id", (F.col(value) / F.col("_s")).alias("share"))


def _rank(partition: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order))


def rank_columns(totals: DataFrame, by: str = "cluster", value: str = "bits") -> DataFrame:
    """Columns by descending value; ties by column.

    One range-partitioned sort numbers all rows; a row's rank is its distance from
    the first row of its cluster, so no cluster has to fit in one task.
    """
    ordered = totals.orderBy(by, F.desc(F.round(value, RANK_DIGITS)), F.asc("col_id"))
    numbered = number_rows(ordered, "_i")
    firsts = numbered.groupBy(by).agg(F.min("_i").alias("_first"))
    return numbered.join(firsts, by).select(
        *totals.columns, (F.col("_i") - F.col("_first") + 1).cast("int").alias("rank")
    )


def top_items(gaps: DataFrame, k: int = ITEMS_PER_TOPIC) -> DataFrame:
    """The ``k`` columns per cluster with the largest absolute gap.

    The rank filter is applied per task before the shuffle (window group limit),
    so a cluster sends ``k`` rows per task and no more.
    """
    size = F.round(F.abs("gap"), RANK_DIGITS)
    return gaps.withColumn("rank", _rank("cluster", F.desc(size), F.asc("col_id"))).filter(
        F.col("rank") <= k
    )


def share_gaps(wbag: DataFrame, clusters: DataFrame, k: int = ITEMS_PER_TOPIC) -> DataFrame:
    """Local minus overall share, for every column that can be in a cluster's top ``k``.

    Columns absent from a cluster have a gap too: their whole overall share.
    Only those whose share reaches the cluster's k-th best present gap can
    matter.  They are found by an equi-join on the power of two of the share,
    so clusters are never crossed with the vocabulary.
    """
    # One pass over the bag: per cluster and column, noise and rows without a
    # cluster under -1.  Everything after works on this much smaller table.
    groups = clusters.select(F.col("id").alias("row_id"), "cluster")
    sums = cut(
        wbag.join(groups, "row_id", "left")
        .groupBy(F.coalesce("cluster", F.lit(-1)).alias("cluster"), "col_id")
        .agg(F.sum("w").alias("bits"))
    )
    totals = sums.groupBy("col_id").agg(F.sum("bits").alias("bits"))
    base = cut(col_distribution(totals).select("col_id", F.col("share").alias("base")))
    local = col_distribution(sums.filter("cluster >= 0"), "cluster").select(
        "cluster", "col_id", F.col("share").alias("local")
    )
    present = local.join(base, "col_id").select(
        "cluster", "col_id", "local", "base", (F.col("local") - F.col("base")).alias("gap")
    )

    best = top_items(present, k).groupBy("cluster").agg(
        F.min(F.abs("gap")).alias("kth"), F.count(F.lit(1)).alias("n")
    )
    # A cluster with fewer than k columns misses at most k-1 of the largest 2k.
    enough = base.orderBy(F.desc("base")).limit(2 * k).agg(F.min("base").alias("v")).scalar()
    floor = F.when(F.col("n") < k, enough).otherwise(F.col("kth")) * (1 - 1e-6)
    level = F.least(F.floor(-F.log2(F.col("floor"))), F.lit(1100)).cast("int")
    wanted = (
        best.select("cluster", floor.alias("floor"))
        .filter("floor > 0")
        .select("cluster", "floor", F.explode(F.sequence(F.lit(0), level)).alias("level"))
    )
    by_level = base.filter("base > 0").withColumn(
        "level", F.least(F.floor(-F.log2("base")), F.lit(1100)).cast("int")
    )
    absent = (
        wanted.join(by_level, "level")
        .filter(F.col("base") >= F.col("floor"))
        .select("cluster", "col_id", "base")
        .join(local.select("cluster", "col_id"), ["cluster", "col_id"], "left_anti")
        .select("cluster", "col_id", F.lit(0.0).alias("local"), "base", (-F.col("base")).alias("gap"))
    )
    return present.unionByName(absent)


def cluster_topics(
    wbag: DataFrame, clusters: DataFrame, k: int = ITEMS_PER_TOPIC, separator: str = "\\"
) -> DataFrame:
    """Per cluster, the columns whose share departs most from the overall share.

    The overall distribution spans all rows, noise included.  Noise itself is
    unlabelled.
    """
    top = top_items(share_gaps(wbag, clusters, k), k)
    part = F.concat(gap_sign(F.col("local"), F.col("base")), base_name(F.col("col_id"), separator))
    topics = top.groupBy("cluster").agg(
        F.collect_list(F.struct("rank", part.alias("text"))).alias("parts")
    )
    return (
        clusters.select("cluster")
        .distinct()
        .join(topics, "cluster", "left")
        .select(
            "cluster",
            F.when(F.col("cluster") < 0, F.lit(UNLABELLED))
            .otherwise(unique_label(join_lines(F.col("parts")), F.col("cluster")))
            .alias("label"),
        )
    )


def cluster_members(instances: DataFrame, clusters: DataFrame, row: str = "row_id") -> DataFrame:
    """Instances with the cluster of the host-time they ran in."""
    return instances.join(clusters.select(F.col("id").alias(row), "cluster"), row)


def attach_bits(members: DataFrame, bits: DataFrame, obj: str = "obj_id") -> DataFrame:
    return members.join(bits.select("cluster", F.col("col_id").alias(obj), "bits"), ["cluster", obj])


def unmatched_bits(bits: DataFrame, members: DataFrame, obj: str = "obj_id") -> DataFrame:
    """Important objects that no member of their cluster ran; empty when sound."""
    return bits.filter(F.col("bits") >= OBJECT_BITS).join(
        members.select("cluster", F.col(obj).alias("col_id")), ["cluster", "col_id"], "left_anti"
    )


def object_names(members: DataFrame) -> DataFrame:
    """Per cluster, object and name: how many instances and which came first.

    This shrinks instances to one row per distinct combination before any join
    with bits; everything later works on that.
    """
    return members.groupBy("cluster", "obj_id", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("timestamp", "pid_hash")).alias("first")
    )


def first_name(names: DataFrame) -> DataFrame:
    """Name of the first instance of each object in each cluster."""
    return names.groupBy("cluster", "obj_id").agg(
        F.min_by("name", F.struct("first", "name")).alias("name")
    )


def name_bits(names: DataFrame) -> DataFrame:
    """Mean bits per name over all instances; ``names`` carries ``n`` and ``bits``."""
    return names.groupBy("cluster", "name").agg(
        (F.sum(F.col("n") * F.col("bits")) / F.sum("n")).alias("bits")
    )


def within_ratio(df: DataFrame, ratio: float = NAME_RATIO) -> DataFrame:
    """Keep names that reach a fraction of the best one of their cluster."""
    best = df.groupBy("cluster").agg(F.max("bits").alias("_best"))
    return df.join(best, "cluster").filter(F.col("bits") >= F.col("_best") / ratio).drop("_best")


def top_names(df: DataFrame, k: int = NAMES_PER_LABEL) -> DataFrame:
    return df.withColumn(
        "rank", _rank("cluster", F.desc(F.round("bits", RANK_DIGITS)), F.asc("name"))
    ).filter(F.col("rank") <= k)


def workload_names(wbag: DataFrame, clusters: DataFrame, instances: DataFrame) -> DataFrame:
    """Dominant program names per cluster with their mean bits and rank.

    ``instances`` has ``row_id, obj_id, name, timestamp, pid_hash``.
    """
    real = clusters.filter("cluster >= 0")
    bits = cluster_bits(wbag, real)
    names = attach_bits(object_names(cluster_members(instances, real)), bits)
    important = first_name(names.filter(F.col("bits") >= OBJECT_BITS)).select("cluster", "name")
    scored = name_bits(names).join(important, ["cluster", "name"], "left_semi")
    return top_names(within_ratio(scored.filter(F.col("bits") >= NAME_BITS)))


def workload_labels(wbag: DataFrame, clusters: DataFrame, instances: DataFrame) -> DataFrame:
    """One label per cluster: up to three ``name bits`` lines, or unlabelled."""
    lines = (
        workload_names(wbag, clusters, instances)
        .groupBy("cluster")
        .agg(
            F.collect_list(
                F.struct("rank", bits_text(F.col("name"), F.col("bits")).alias("text"))
            ).alias("parts")
        )
    )
    text = F.when(F.size("parts") > 0, join_lines(F.col("parts")))
    return (
        clusters.select("cluster")
        .distinct()
        .join(lines, "cluster", "left")
        .select("cluster", F.coalesce(text, F.lit(UNLABELLED)).alias("label"))
    )


def label_centres(points: DataFrame) -> DataFrame:
    """Label anchor at the mean of its points."""
    return points.groupBy("label").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")
    )


def label_medoids(points: DataFrame) -> DataFrame:
    """Label anchor at the member with the least summed squared distance to the others.

    That sum is ``n * |p - mean|^2`` plus a constant of the label, so the member
    nearest the mean is the exact minimiser and no pairs are formed.
    """
    centres = label_centres(points).select("label", F.col("x").alias("_cx"), F.col("y").alias("_cy"))
    off = F.pow(F.col("x") - F.col("_cx"), 2) + F.pow(F.col("y") - F.col("_cy"), 2)
    return (
        points.join(centres, "label")
        .groupBy("label")
        .agg(F.min_by(F.struct("id", "x", "y"), F.struct(F.round(off, 12), "id")).alias("m"))
        .select("label", "m.id", "m.x", "m.y")
    )


def label_spread(points: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Mean distance of a label's points to its anchor (its centre by default)."""
    anchors = label_centres(points) if anchors is None else anchors
    centres = anchors.select("label", F.col("x").alias("_cx"), F.col("y").alias("_cy"))
    return (
        points.join(centres, "label")
        .groupBy("label")
        .agg(F.avg(F.hypot(F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy"))).alias("spread"))
    )

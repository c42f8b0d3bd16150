"""Unique objects, item lists and bags kept as ``(row_id, col_id, n)`` triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemap.functions.text import UNLABELLED
from telemap.session import pin

# A nested list longer than this is written as several rows, so that no single
# record has to hold an unbounded group.
LIST_LIMIT = 100_000


def object_id(value: Column) -> Column:
    return F.xxhash64(value)


def uniques(df: DataFrame, col: str, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Distinct values of ``col`` with their first instance and multiplicity.

    "First" is by ``order`` and then ``key``, a total order.  Partial
    aggregation runs before the shuffle, so a value that fills a third of the
    table costs one row per map task.
    """
    first = F.struct(*[F.col(c) for c in order], F.col(key))
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("obj"))
        .agg(F.min_by(F.col(key), first).alias("first_key"), F.count(F.lit(1)).alias("n"))
        .select(object_id(F.col("obj")).alias("obj_id"), "obj", "first_key", "n")
    )


def clashing_ids(uniq: DataFrame) -> DataFrame:
    """Ids shared by two different objects; empty unless the hash collided."""
    return uniq.groupBy("obj_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def membership(df: DataFrame, col: str, key: str) -> DataFrame:
    """Which unique object each instance is; a projection, no shuffle."""
    return df.filter(F.col(col).isNotNull()).select(key, object_id(F.col(col)).alias("obj_id"))


def deunique(instances: DataFrame, per_object: DataFrame) -> DataFrame:
    """Carry per-object results back to all instances.

    The right side has one row per object, so a hot object skews only the left
    side, which adaptive execution splits.
    """
    return instances.join(per_object, "obj_id", "inner")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, col: str, k: int = 25) -> DataFrame:
    """The ``k`` most frequent values; equal counts go by value."""
    return (
        value_counts(df.filter(F.col(col).isNotNull()), col)
        .orderBy(F.desc("n"), F.asc(col))
        .limit(k)
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def split_hot(df: DataFrame, keys: Sequence[str], spread: str, limit: int = LIST_LIMIT) -> DataFrame:
    """Add ``part``: 0 for ordinary groups, a hash bucket for groups over ``limit``."""
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("long").alias("_parts"))
    )
    return (
        df.join(hot, list(keys), "left")
        .withColumn(
            "part",
            F.when(F.col("_parts").isNull(), F.lit(0).cast("long")).otherwise(
                F.pmod(F.xxhash64(spread), F.col("_parts"))
            ),
        )
        .drop("_parts")
    )


def collect_items(df: DataFrame, key: str, item: str, limit: int = LIST_LIMIT) -> DataFrame:
    """Sorted item list per key; a list over ``limit`` continues in further parts.

    Use :func:`bag_of_pairs` when only counts are needed: it collects nothing.
    """
    numbered = df.select(key, item, F.monotonically_increasing_id().alias("_i"))
    return (
        split_hot(numbered, [key], "_i", limit)
        .groupBy(key, "part")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )


def bag(df: DataFrame, row: str, items: str) -> DataFrame:
    """Counts of each element of the array column ``items`` per ``row``.

    The outer explode keeps Spark from testing the array a second time below the
    projection that makes it, which would split every text twice.
    """
    long = df.select(F.col(row).alias("row_id"), F.explode_outer(items).alias("col_id"))
    return (
        long.filter(F.col("col_id").isNotNull())
        .groupBy("row_id", "col_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def shifted_tokens(df: DataFrame, tokens: str, radius: int, keep: Sequence[str] = ()) -> DataFrame:
    """One row per place of a sequence: its token ``t0`` and the next ones ``t1..``.

    The sequence is zipped with shifted copies of itself, which takes time in
    proportion to its length; slicing at every place would be quadratic.
    """
    n = F.size(tokens)
    copies = [
        F.slice(tokens, F.lit(d + 1), F.greatest(n - d, F.lit(0))).alias(f"t{d}")
        for d in range(1, radius + 1)
    ]
    zipped = F.arrays_zip(F.col(tokens).alias("t0"), *copies)
    return df.select(*keep, F.inline_outer(zipped).alias("t0", *[f"t{d}" for d in range(1, radius + 1)]))


def bag_of_ngrams(df: DataFrame, row: str, items: str, n: int = 1) -> DataFrame:
    """As :func:`bag`, over runs of ``n`` neighbouring elements joined by a space."""
    if n == 1:
        return bag(df, row, items)
    places = shifted_tokens(df, items, n - 1, [F.col(row).alias("row_id")])
    return (
        places.filter(F.col(f"t{n - 1}").isNotNull())
        .groupBy("row_id", F.concat_ws(" ", *[f"t{d}" for d in range(n)]).alias("col_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bag_of_pairs(df: DataFrame, key: str, item: str) -> DataFrame:
    return (
        df.filter(F.col(item).isNotNull())
        .groupBy(F.col(key).alias("row_id"), F.col(item).alias("col_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def edges_to_bag(
    edges: DataFrame, row: Sequence[str], col: str, n: str, dictionary: DataFrame | None = None
) -> DataFrame:
    """Sum an edge list into a bag whose columns are those of ``dictionary``.

    Columns without entries need no rows in triple form; edges outside the
    pinned column set are dropped.
    """
    row_id = F.col(row[0]) if len(row) == 1 else F.struct(*row)
    picked = edges.select(row_id.alias("row_id"), F.col(col).alias("col_id"), F.col(n).alias("n"))
    if dictionary is not None:
        picked = picked.join(dictionary.select("col_id"), "col_id", "left_semi")
    return picked.groupBy("row_id", "col_id").agg(F.sum("n").alias("n"))


def bag_stats(triples: DataFrame) -> DataFrame:
    """Rows, columns, non-zeros and total of a bag, in one row.

    Rows and columns are counted by two grouped passes instead of one expanded
    distinct aggregate, so nothing is multiplied before the shuffle.
    """
    rows = triples.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("_nnz"), F.sum("n").alias("_total")
    )
    per_rows = rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("_nnz").alias("n_nonzero"),
        F.sum("_total").alias("total"),
    )
    n_cols = triples.select("col_id").distinct().agg(F.count(F.lit(1)).alias("c")).scalar()
    return per_rows.select("n_rows", n_cols.alias("n_cols"), "n_nonzero", "total")


def col_totals(wbag: DataFrame) -> DataFrame:
    return wbag.groupBy("col_id").agg(F.sum("w").alias("total"))


def token_dictionary(triples: DataFrame) -> DataFrame:
    """Distinct columns numbered in value order, without a one-task window.

    Range partitioning sorts the tokens in parallel; each partition then starts
    at the number of tokens before it.
    """
    ordered = triples.select("col_id").distinct().orderBy("col_id")
    return number_rows(ordered, "idx")


def number_rows(ordered: DataFrame, out: str) -> DataFrame:
    """Dense 0-based numbers following the partition order of ``ordered``.

    Each row knows its place inside its partition; a table with one row per
    partition holds how many rows come before, and is small enough to broadcast
    for that reason.  The input is materialised first so that both passes see
    the same partitions.
    """
    fixed = pin(ordered).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    sizes = fixed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return (
        fixed.withColumn("_p", part)
        .join(F.broadcast(starts), "_p")
        .withColumn(out, F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_p", "_m", "_s")
    )


def coverage(processes: DataFrame, loads: DataFrame, key: str = "pid_hash") -> DataFrame:
    """How many objects there are and how many have no recorded item."""
    missing = (
        processes.join(loads.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("c")).scalar()
    )
    return processes.agg(F.count(F.lit(1)).alias("n_objects")).select(
        "n_objects", missing.alias("n_without_items")
    )


def attach_metadata(lists: DataFrame, meta: DataFrame, key: str = "pid_hash") -> DataFrame:
    """Left join of metadata that must not change the number of rows."""
    return lists.join(meta, key, "left")


def multiplied_rows(meta: DataFrame, key: str = "pid_hash") -> DataFrame:
    """Keys that would multiply rows in :func:`attach_metadata`; empty when sound."""
    return meta.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def lookup_tokens(df: DataFrame, dictionary: DataFrame, on: str = "idx") -> DataFrame:
    return df.join(dictionary, on, "inner")


def bucket_labels(df: DataFrame, col: str, top: DataFrame, out: str = "label") -> DataFrame:
    """Fold values outside ``top`` into the unlabelled bucket.

    ``top`` has k rows by construction, which is the size bound of the broadcast.
    """
    kept = F.broadcast(top.select(F.col(col).alias("_kept")))
    return (
        df.join(kept, F.col(col) == F.col("_kept"), "left")
        .withColumn(out, F.coalesce("_kept", F.lit(UNLABELLED)))
        .drop("_kept")
    )


def explode_pairs(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    """One row per struct of the array column ``col``, with its fields as columns."""
    return df.select(*keep, F.inline(col))

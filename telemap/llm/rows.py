"""Keys of rows, ranges of rows and components, shared by the operators here."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemap.session import cut, forget

LAST = (1 << 63) - 1


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` with ``ord`` (the id; rows without one come last) and ``th``.

    ``(ord, th)`` names a row up to copies of id and text, whose results are equal.
    """
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("ord"),
        F.xxhash64(F.col(text)).alias("th"),
        F.col(text).cast("string").alias("text"),
    )


def send(spark: SparkSession, thing: Any) -> Callable[[], Any]:
    """Broadcasts a thing of bounded size; the result, called in a task, gives it back.

    Classes travel with it, so executors need no copy of this package.
    """
    box = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(box.value)


def utf8_size(text: str | Column) -> Column:
    """Bytes of a text in UTF-8, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """``row`` (a struct of all columns), ``part`` and ``nth``: sorted slices of the table.

    Rows are dealt to partitions by ranges of ``order``; a tie of any size is split by
    the place a row has in its input. The table is written, so ``part`` stays as it is
    when tasks run again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.select(F.struct("*").alias("row"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    spread = spread.withColumn("tie", F.monotonically_increasing_id())
    keys = [*(f"o{i}" for i in range(len(order))), "tie"]
    ranged = spread.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return cut(ranged.select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")))


def prefix_sums(ranged: DataFrame, size: Column) -> DataFrame:
    """Adds ``rank`` (rows before) and ``before`` (sizes before) over the whole table.

    Totals of the partitions are summed up first: a table of as many rows as there
    are partitions, which alone is ordered in one task and broadcast.
    """
    sized = ranged.withColumn("size", size)
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("size").over(by_part), F.lit(0)).alias("size_start"),
        F.coalesce(F.sum("rows").over(by_part), F.lit(0)).alias("row_start"),
    )
    inside = Window.partitionBy("part").orderBy("nth")
    return (
        sized.withColumn("rank", F.row_number().over(inside) - 1)
        .withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(starts), "part")
        .withColumn("rank", F.col("rank") + F.col("row_start"))
        .withColumn("before", F.col("before") + F.col("size_start"))
        .drop("size_start", "row_start")
    )


def components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each node of an edge can reach.

    Every round each node takes its smallest neighbour, if smaller than itself, as its
    label, then the label of that label; edges between labels go on to the next round,
    those within one are done. So a star is gone after one round, and what is left
    shrinks by at least half.
    """
    left = cut(edges.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a <> b").distinct())
    labels = None
    while True:
        both = left.union(left.select("b", "a"))
        near = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
        far = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
        hops = cut(near.join(far, "label").select("node", F.col("far").alias("label")))
        if labels is None:
            after = hops.withColumnRenamed("label", "component")
        else:
            moved = hops.select(F.col("node").alias("component"), F.col("label"))
            after = cut(
                labels.join(moved, "component", "left").select("node", F.coalesce("label", "component").alias("component"))
            )
        one = left.join(hops.select(F.col("node").alias("a"), F.col("label").alias("c")), "a")
        two = one.join(hops.select(F.col("node").alias("b"), F.col("label").alias("d")), "b")
        following = cut(two.filter("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b")).distinct())
        forget(left, near)
        labels, left = after, following
        if not left.limit(1).count():
            return labels

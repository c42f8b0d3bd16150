"""Contiguous shards of near equal size from prefix sums (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemap.llm.rows import in_ranges, prefix_sums, utf8_size


def contiguous_shards(docs: DataFrame, size: Column | None = None, shards: int = 16, order: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``size``, ``shard`` and ``slot``.

    Rows are put in order of ``order`` (null first; rows that share an id follow each
    other in the order they are stored in). A row belongs to the shard in which the
    middle of its bytes falls when all sizes are laid end to end and cut into
    ``shards`` equal lengths, so a shard is at most one row away from its target.
    ``slot`` counts the rows of a shard from 0. A row without text has size 1; a row
    larger than a whole target leaves shards empty. An empty table gives an empty
    result. Columns of the input named ``size``, ``shard`` or ``slot`` are replaced.
    """
    size = utf8_size("text") + 1 if size is None else size
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    ranged = in_ranges(docs.select(*kept, size.cast("long").alias("size")), F.col(order))
    placed = prefix_sums(ranged, F.col("row.size"))
    total = ranged.agg(F.sum("row.size")).first()[0] or 1
    middle = F.expr(f"({shards} * (2 * before + size)) div {2 * total}")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), middle).cast("int"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        *[F.col(f"row.`{c}`") for c in kept], "size", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot")
    )

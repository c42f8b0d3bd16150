"""Information weights: how many bits a column tells about the row it sits in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemap.session import cut


#: columns whose weights are broadcast: those with the most entries
COMMON = 50_000


def with_row_sums(bag: DataFrame) -> DataFrame:
    """The bag with the sum ``r`` of each entry's row; no shuffle where rows are together."""
    return bag.withColumn("r", F.sum("n").over(Window.partitionBy("row_id")).cast("double"))


def information_weights(bag: DataFrame, prior: float = 0.0) -> DataFrame:
    """Bits per column of a bag ``(row_id, col_id, n)``.

    For counts n, row sums r, column sums c and total T the weight is the
    divergence of "which row, given the column" from "which row at all"::

        bits = sum_i n_i/c * log2((n_i/c) / (r_i/T))

    Taking the logarithm apart leaves per-entry terms that need only the row
    sum, so one join on the row and one aggregate on the column suffice.  Both
    aggregates combine before the shuffle.  A bag :func:`with_row_sums` needs no join.
    """
    total = bag.agg(F.sum("n").cast("double").alias("t")).scalar()
    if "r" in bag.columns:
        bag = bag.filter(F.col("row_id").isNotNull())
    else:
        rows = bag.groupBy("row_id").agg(F.sum("n").cast("double").alias("r"))
        bag = bag.join(rows, "row_id")
    entries = bag.select("col_id", F.col("n").cast("double").alias("n"), "r")
    if prior == 0.0:
        sums = entries.groupBy("col_id").agg(
            F.sum("n").alias("c"), F.sum(F.col("n") * (F.log2("n") - F.log2("r"))).alias("s")
        )
        bits = F.col("s") / F.col("c") - F.log2("c") + F.log2(total)
        return sums.select("col_id", F.greatest(bits, F.lit(0.0)).alias("bits"))

    # With a prior every row has some mass in every column; rows without an
    # entry share one closed-form term, so work stays on the entries.
    alpha = F.lit(float(prior))
    share = F.col("r") / total
    mixed = F.col("n") + alpha * share
    sums = entries.groupBy("col_id").agg(
        F.sum("n").alias("c"),
        F.sum(mixed * (F.log2(mixed) - F.log2(share))).alias("s"),
        F.sum(mixed).alias("m"),
        F.sum(share).alias("b"),
    )
    whole = F.col("c") + alpha
    absent = F.greatest(F.lit(1.0) - F.col("b"), F.lit(0.0)) * alpha / whole * F.log2(alpha / whole)
    bits = F.col("s") / whole - F.col("m") / whole * F.log2(whole) + absent
    return sums.select("col_id", F.greatest(bits, F.lit(0.0)).alias("bits"))


#: columns of fewer bits tell nothing: every row holds them in proportion to its size,
#: and what is left is the rounding of the sums
NO_BITS = 1e-9


def reweight(bag: DataFrame, weights: DataFrame, drop_zero: bool = False) -> DataFrame:
    """Counts to bits: ``w = n * bits`` of the column; with ``drop_zero`` without columns of no bits.

    A row may lose all its entries; callers that need every row keep its id beside the bag.
    """
    if drop_zero:
        weights = weights.filter(F.col("bits") > NO_BITS)
    out = bag.join(weights, "col_id").select(
        "row_id", "col_id", (F.col("n") * F.col("bits")).alias("w")
    )
    return out


def information_bag(bag: DataFrame) -> DataFrame:
    """As :func:`reweight` by :func:`information_weights`, for bags that are large beside ``COMMON`` columns.

    Entries of the ``COMMON`` most frequent columns meet their weights where they are;
    only those of the rest are dealt by column.
    """
    bag = cut(with_row_sums(bag))
    bits = cut(information_weights(bag))
    sizes = bag.groupBy("col_id").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.orderBy(F.desc("_n"), "col_id").limit(COMMON).select("col_id")
    common = cut(bits.join(F.broadcast(first), "col_id"))
    marked = bag.join(F.broadcast(common), "col_id", "left")
    weighted = (F.col("n") * F.col("bits")).alias("w")
    near = marked.filter(F.col("bits").isNotNull()).select("row_id", "col_id", weighted)
    rest = marked.filter(F.col("bits").isNull()).select("row_id", "col_id", "n")
    return near.unionByName(reweight(rest, bits))

"""Time bins per host and the bags of objects run in them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemap.operators.bags import LIST_LIMIT, split_hot

# Bin width and bin origin (midnight of the first captured day at -05:00).
BIN_HOURS = 3
BIN_ORIGIN = "2023-11-05 05:00:00"

HOST_BIN = ("bin", "hostname")


def _epoch(origin: str) -> int:
    return int(datetime.fromisoformat(origin).replace(tzinfo=timezone.utc).timestamp())


def bin_start(ts: Column, hours: int = BIN_HOURS, origin: str = BIN_ORIGIN) -> Column:
    """Window expression for left-closed bins anchored at ``origin`` (UTC)."""
    offset = _epoch(origin) % (hours * 3600)
    return F.window(ts, f"{hours} hours", startTime=f"{offset} seconds")


def time_bin(
    df: DataFrame,
    ts: str = "timestamp",
    hours: int = BIN_HOURS,
    origin: str = BIN_ORIGIN,
    reject_before_origin: bool = False,
) -> DataFrame:
    """Add column ``bin``, the start of the bin the row falls in.

    Bins before the origin exist and are kept unless ``reject_before_origin``.
    """
    if reject_before_origin:
        df = df.filter(F.col(ts) >= F.lit(origin).cast("timestamp"))
    return df.withColumn("_w", bin_start(F.col(ts), hours, origin)).select(
        *df.columns, F.col("_w.start").alias("bin")
    )


def host_time_counts(binned: DataFrame) -> DataFrame:
    """How often each object ran per host and bin; one shuffle with map-side counts."""
    return binned.groupBy("bin", "hostname", "obj_id").agg(F.count(F.lit(1)).alias("n"))


def host_times(binned: DataFrame, key: str = "pid_hash", limit: int = LIST_LIMIT) -> DataFrame:
    """Nested form: per host and bin, the (object, count) pairs and the instance ids.

    A host-time over ``limit`` instances continues in further ``part`` rows.
    Later stages use the long form, which nests nothing.
    """
    parts = split_hot(binned.select("bin", "hostname", key), HOST_BIN, key, limit)
    ids = parts.groupBy("bin", "hostname", "part").agg(
        F.array_sort(F.collect_list(key)).alias("pids")
    )
    pairs = (
        split_hot(host_time_counts(binned), HOST_BIN, "obj_id", limit)
        .groupBy("bin", "hostname", "part")
        .agg(F.array_sort(F.collect_list(F.struct("obj_id", "n"))).alias("counts"))
    )
    return pairs.join(ids, ["bin", "hostname", "part"], "full").select(
        "bin", "hostname", "part", "counts", "pids"
    )


def host_time_id(host: Column, start: Column) -> Column:
    """String key of a host-time."""
    return F.concat(host, F.lit("|"), F.date_format(start, "yyyy-MM-dd HH:mm:ss"))


def number_host_times(df: DataFrame) -> DataFrame:
    """Host-times in (bin, host) order with a dense number."""
    from telemap.operators.bags import number_rows

    return number_rows(df.select(*HOST_BIN).distinct().orderBy(*HOST_BIN), "row_number")


def time_span(df: DataFrame, ts: str = "bin") -> DataFrame:
    return df.agg(F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max")).select(
        "ts_min",
        "ts_max",
        (F.unix_micros("ts_max") - F.unix_micros("ts_min")).alias("span_micros"),
    )


def time_fraction(df: DataFrame, ts: str = "bin", out: str = "fraction") -> DataFrame:
    """Time scaled to [0, 1] over the table; 0 everywhere if there is one time only."""
    low = df.agg(F.min(F.unix_micros(ts)).alias("v")).scalar()
    high = df.agg(F.max(F.unix_micros(ts)).alias("v")).scalar()
    span = F.nullif(high - low, F.lit(0))
    return df.withColumn(out, F.coalesce((F.unix_micros(ts) - low) / span, F.lit(0.0)))


def host_path(points: DataFrame, keys: Sequence[str] = ("hostname",)) -> DataFrame:
    """Each host's way over the map: every point with the one before it in time.

    A host has one point per bin, so a window holds as many rows as there are
    bins in the capture period, however many processes ran.
    """
    before = Window.partitionBy(*keys).orderBy("bin")
    return points.select(
        *keys,
        "bin",
        "x",
        "y",
        F.lag("x").over(before).alias("from_x"),
        F.lag("y").over(before).alias("from_y"),
    )

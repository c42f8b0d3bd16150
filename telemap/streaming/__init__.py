"""Curation, binning and scoring on unbounded inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.operators import bags, curate, hosttime

__all__ = ["stream_curate", "stream_host_time_counts", "stream_scores"]


def stream_curate(
    process: DataFrame,
    paths: DataFrame,
    needles: Sequence[str] = curate.AGENT_MARKS,
    start: str = curate.CAPTURE_START,
) -> DataFrame:
    """The curation query on a stream of processes and a static table of tree paths.

    Stateless: the same plan as the batch query, joined per micro-batch.
    """
    return curate.curate(process, paths, needles, start)


def stream_host_time_counts(
    processes: DataFrame,
    lateness: str = "3 hours",
    hours: int = hosttime.BIN_HOURS,
    origin: str = hosttime.BIN_ORIGIN,
) -> DataFrame:
    """Object counts per host and bin; a bin is emitted once no row can be that late.

    State holds one count per open (bin, host, object).
    """
    bin_ = hosttime.bin_start(F.col("timestamp"), hours, origin).alias("window")
    return (
        processes.filter(F.col("cmdline").isNotNull())
        .withWatermark("timestamp", lateness)
        .groupBy(bin_, "hostname", bags.object_id(F.col("cmdline")).alias("obj_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("bin"), "hostname", "obj_id", "n")
    )


def stream_scores(bag: DataFrame, weights: DataFrame) -> DataFrame:
    """Bits of newly arriving bag entries from stored column weights.

    Columns never weighed before have no weight yet and come out as null.
    """
    return bag.join(weights.select("col_id", "bits"), "col_id", "left").select(
        "row_id", "col_id", (F.col("n") * F.col("bits")).alias("w")
    )

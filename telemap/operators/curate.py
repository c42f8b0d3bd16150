"""Curation: project, filter and join the raw process tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemap.functions.text import cmdline

# The tree-path marks of the telemetry agents' own activity and
# the start of the nominal capture period.
AGENT_MARKS = ("wintap", "amazon-ssm")
CAPTURE_START = "2023-11-05 00:00:00"


def select_process(process: DataFrame) -> DataFrame:
    """Project raw processes; keeps ``first_seen`` out, so filter sightings before."""
    return process.select(
        "pid_hash",
        "parent_pid_hash",
        F.col("process_started").alias("timestamp"),
        "hostname",
        F.col("process_name").alias("name"),
        cmdline(F.col("process_path"), F.col("args")).alias("cmdline"),
    )


def select_image_loads(loads: DataFrame) -> DataFrame:
    return loads.select("pid_hash", "filename", F.col("first_seen").alias("timestamp"))


def exclude_subtrees(df: DataFrame, col: str, needles: Iterable[str]) -> DataFrame:
    """Drop rows whose tree path holds any needle; a null path goes too."""
    keep: Column = reduce(
        lambda acc, needle: acc & ~F.col(col).contains(needle), needles, F.col(col).isNotNull()
    )
    return df.filter(keep)


def in_period(df: DataFrame, ts: str, start: str) -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))


def first_sightings(process: DataFrame) -> DataFrame:
    return process.filter(F.col("process_started") == F.col("first_seen"))


def with_tree(process: DataFrame, paths: DataFrame) -> DataFrame:
    return process.join(paths.select("pid_hash", "ptree"), "pid_hash", "inner")


def loads_of(loads: DataFrame, kept: DataFrame, unique_ids: bool = True) -> DataFrame:
    """Image loads of kept processes.

    The join adds no column, so with unique process ids it is a semi-join, which
    cannot multiply rows and ships only the ids.
    """
    how = "left_semi" if unique_ids else "inner"
    return loads.join(kept.select("pid_hash"), "pid_hash", how)


def order_processes(df: DataFrame) -> DataFrame:
    return df.orderBy("timestamp", "hostname", "pid_hash")


def order_loads(df: DataFrame) -> DataFrame:
    return df.orderBy("timestamp", "pid_hash", "filename")


def curate(
    process: DataFrame,
    paths: DataFrame,
    needles: Sequence[str] = AGENT_MARKS,
    start: str = CAPTURE_START,
) -> DataFrame:
    """Processes of the capture period, seen for the first time, outside agent subtrees."""
    kept = select_process(first_sightings(in_period(process, "process_started", start)))
    return with_tree(kept, exclude_subtrees(paths, "ptree", needles))


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def narrow(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def restrict_to(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")

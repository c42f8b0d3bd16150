"""Session defaults and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: tables written by ``cut`` inside each running ``settled``, innermost last
_WRITTEN: list[list[DataFrame]] = []
#: bytes of an Arrow batch that goes to a Python worker inside ``settled``, at most
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: whether a query's shuffle files go when it ends, and not when the driver collects its garbage
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "telemap", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution coalesces small shuffles and splits skewed join
    partitions at run time; the zone is pinned so that time bins do not depend
    on the machine.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        # written tables are compressed; a plan must not take their files' size for that of their rows
        .config("spark.sql.sources.fileCompressionFactor", "4.0")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A session on one machine that names none (a test) gets a temporary one; on a
    cluster that is an error, since executors would not see each other's tables.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="telemap-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table inside the shared folder."""
    return os.path.join(shared_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Used between rounds of iterative jobs: the table survives lost executors, the
    next round plans against a plain scan of known size, and no constraints pile
    up in the optimiser as they do over chained checkpoints. The shuffles that made it are
    deleted once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    usual = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, usual)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    if _WRITTEN:
        _WRITTEN[-1].append(table)
    return table


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``build`` returns and delete the tables that ``cut`` wrote on the way.

    An operator that leaves only its result behind costs no disk while later ones run.
    Its rows go to Python workers in batches of ``BATCH_BYTES`` at most, so that tasks with
    wide rows stay small on both sides.
    """
    spark = SparkSession.getActiveSession()
    usual = spark.conf.get(_BATCH) if spark else None
    if spark:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    _WRITTEN.append([])
    try:
        result = build()
    except BaseException:
        _WRITTEN.pop()
        raise
    else:
        tables = _WRITTEN.pop()
        table = cut(result)
    finally:
        if spark:
            spark.conf.set(_BATCH, usual)
    forget(*(t for t in tables if t is not result))
    if getattr(result, "_cut_path", None):
        forget(result)
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for table in tables:
        path = getattr(table, "_cut_path", None)
        if path is None:
            continue
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        table._cut_path = None


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``, keeping its partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input that sits in fewer splits than there are cores.

    A table of any size has more splits than that and is left as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df

"""Reading source tables and handing stage results from one job to the next."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemap.sources import schemas


def read_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan the Parquet table ``name`` under ``folder``.

    Zoneless times become zoned ones here, once, because time windows and
    watermarks need them.  The cast is a projection above the scan: filters and
    column selection still reach Parquet.
    """
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    zoneless = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    if not zoneless:
        return df
    return df.select(
        [F.col(c).cast("timestamp").alias(c) if c in zoneless else F.col(c) for c in df.columns]
    )


def register_views(spark: SparkSession, folder: str, names: Iterable[str]) -> list[str]:
    """Register source tables as lazy views for SQL text; returns the names."""
    registered = []
    for name in names:
        read_source(spark, folder, name).createOrReplaceTempView(name)
        registered.append(name)
    return registered


def save_stage(df: DataFrame, path: str, order: Iterable[str] = ()) -> None:
    """Write a stage result as zstd Parquet.

    ``order`` sorts inside each file, which tightens the column statistics that
    later scans skip by; a total order over all files is not attempted.
    """
    order = list(order)
    if order:
        df = df.sortWithinPartitions(*order)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a stage result; with ``schema`` no file footer is read for inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def save_triples(triples: DataFrame, path: str) -> None:
    """Write a sparse matrix kept as ``(row_id, col_id, value)``.

    Range partitioning keeps a row's entries together without forcing one huge
    row into one file: the column takes part in the range key.
    """
    save_stage(
        triples.repartitionByRange("row_id", "col_id"), path, ["row_id", "col_id"]
    )


def load_triples(spark: SparkSession, path: str) -> DataFrame:
    return load_stage(spark, path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Write dense rows ``(id, vec array<double>)``."""
    save_stage(vectors.select("id", F.col("vec").cast("array<double>").alias("vec")), path, ["id"])


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return load_stage(spark, path)


def save_dictionary(labels: DataFrame, path: str) -> None:
    """Write the label ranks as JSON lines."""
    labels.select("label", F.col("rank").cast("long").alias("rank")).write.mode("overwrite").json(
        path
    )


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DICTIONARY).json(path)

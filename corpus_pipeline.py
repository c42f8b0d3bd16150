"""A corpus from raw documents: five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemap.llm.contamination import contamination, is_contaminated
from telemap.llm.mixing import mix, repeated
from telemap.llm.neardup import near_duplicates
from telemap.llm.quality import judge_quality
from telemap.llm.rows import LAST
from telemap.llm.sharding import contiguous_shards
from telemap.session import cut, forget, settled

#: The stages rest on iterated estimates and fits; the tests hold each against a brute-force version.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """``row`` with all columns, and the key ``ord, th`` that the operators give back."""
    return docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
        F.xxhash64("text").alias("th"),
    )


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept.

    Null and empty texts fail; repeated rows share a verdict and stay or go together; an
    empty table stays empty. Null languages and sources are values of their own.
    """
    return judge_quality(docs).filter("kept").select("row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; texts without words all stay.

    Of rows equal in id and text one is kept.
    """
    groups = near_duplicates(docs).filter("n_shingles > 0")
    first = groups.groupBy("component").agg(F.min(F.struct("ord", "rid", "th")).alias("f")).select("f.ord", "f.th")
    has_words = F.coalesce(F.col("row.text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rows = _packed(docs)
    one = Window.partitionBy("ord", "th").orderBy(F.xxhash64("row"))
    full = rows.filter(has_words).withColumn("nth", F.row_number().over(one)).filter("nth = 1")
    kept = full.join(cut(first), ["ord", "th"], "left_semi")
    return kept.select("row.*").union(rows.filter(~has_words).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null and empty texts have no words and stay; repeated rows share a verdict; rows
    without an id are told apart by their text. An empty table or benchmark takes nothing out.
    """
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(is_contaminated())
    dirty = cut(found.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), "th").distinct())
    return _packed(docs).join(dirty, ["ord", "th"], "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say.

    Null and empty texts have no features and get the rate of the classifier's offsets;
    repeated rows have one rate; without labels every rate is 1. An empty table stays empty.
    """
    return repeated(mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``size``, ``shard`` and ``slot``.

    A null text has size 1; rows without an id come last; repeated rows get slots of their
    own. An empty table stays empty.
    """
    return contiguous_shards(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's table lies in the shared folder.

    What a stage wrote on the way, and what it read, is deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = docs
        docs = settled(lambda: stage(spark, before, sf_dir))
        forget(before)
    return docs

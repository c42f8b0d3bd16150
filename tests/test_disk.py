"""What stays on disk while a job runs."""

import glob

import pytest
from pyspark.sql import functions as F

from telemap.operators import cooccurrence
from telemap.session import cut, forget


def _shuffle_files(spark) -> set[str]:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for folder in manager.localDirsString() for f in glob.glob(f"{folder}/**/shuffle_*.data", recursive=True)}


def test_written_table_leaves_no_shuffle(spark):
    sums = spark.range(20_000).groupBy((F.col("id") % 997).alias("a")).agg(F.sum("id").alias("s"))
    before = _shuffle_files(spark)
    table = cut(sums)
    assert not _shuffle_files(spark) - before
    assert table.count() == 997
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    forget(table)


LINES = [["a", "b", "a", "c", "a", "d"], ["a"], [], None, ["b", None, "c", "a"], [None, "a", "b"], ["a", "b"]]


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_windows_of_rare_and_frequent_tokens(spark, limit):
    want: dict = {}
    for line in LINES:
        for i, one in enumerate(line or []):
            for d in (1, 2):
                if i + d < len(line) and line[i + d] is not None:
                    for kernel, w in (("flat", 1.0), ("harmonic", 1.0 / d)):
                        key = one, line[i + d], kernel
                        want[key] = want.get(key, 0.0) + w
    rows = spark.createDataFrame([(line,) for line in LINES], "tokens array<string>")
    found = cooccurrence.windowed_cooccurrence(rows, radius=2, kernel=("flat", "harmonic"), limit=limit)
    got = {(r["c1"], r["c2"], kernel): r[kernel] for r in found.collect() for kernel in ("flat", "harmonic")}
    assert got == pytest.approx(want)


def test_windows_travel_and_not_pairs(spark):
    """Tokens that are not frequent are dealt by place: a row for up to ``radius`` pairs."""
    rows = spark.range(400).selectExpr("transform(sequence(0, 20), i -> string(pmod(xxhash64(id, i), 3000))) AS tokens")
    found = cooccurrence.windowed_cooccurrence(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(t0" in plan
    assert found.agg(F.sum("w")).first()[0] == 400 * (16 * 5 + 4 + 3 + 2 + 1)

"""Registered queries against their SQL, plan shapes, and a whole study."""

import pytest
from pyspark.sql import functions as F

from compare import differences
from conftest import SMALL
from telemap.operators import curate
from telemap.plans import all_queries, all_sql, inputs, studies

QUERIES = sorted(all_sql())
# Their results have property tests; here each runs as it is registered.
ROWS_ONLY = sorted(set(all_queries()) - set(all_sql()))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    assert differences(spark, SMALL, name) == []


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_runs(spark, name):
    rows = all_queries()[name](spark, SMALL).collect()
    ids = [r["id"] for r in rows]
    assert rows and len(ids) == len(set(ids))


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    kept = curate.in_period(inputs.process(spark, SMALL), "process_started", inputs.TEST_START)
    text = plan(kept.select("pid_hash", "hostname"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = plan(curate.exclude_subtrees(rows, "source", ["src1"]).select("doc_id"))
    assert "Not(StringContains(source,src1))" in text


@pytest.mark.parametrize(
    "name", ["curate_processes", "token_bag", "info_weights", "reweighted_docs", "windowed_cooc", "host_time_counts"]
)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(all_queries()[name](spark, SMALL))
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(all_queries()["top_items"](spark, SMALL))


def test_whole_study(spark, tmp_path):
    opts = studies.Options(
        vector_width=8, cloud=4, embedding_width=8, neighbors=5, epochs=2, smoothing=1, levels=3
    )
    processes = inputs.all_processes(spark, SMALL)
    study = studies.command_lines(processes, opts)
    vectors = studies.command_line_vectors(study, opts)
    n = study["uniques"].count()
    assert vectors["vectors"].count() == n
    both = studies.comparison(study, vectors["vectors"], opts)
    assert 0 < both.count() <= n
    studies.save({"table": study["map_table"], "both": both}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "both")).count() == both.count()


def test_image_and_host_studies(spark):
    opts = studies.Options(
        vector_width=6, cloud=4, embedding_width=6, neighbors=5, epochs=1, levels=2, smoothing=0
    )
    loads = curate.select_image_loads(inputs.process_image_load(spark, SMALL))
    processes = inputs.order_processes(spark, SMALL).withColumn("cmdline", F.lit('"c:\\a.exe" -x'))
    images = studies.image_loads(processes, loads, opts)
    table = images["map_table"].collect()
    assert len(table) == loads.select("pid_hash").distinct().count()
    assert {r["hover_text"] for r in table} <= {
        f"{n} -x" for n in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    }

    runs = inputs.all_processes(spark, SMALL)
    vectors = (
        runs.select(F.xxhash64("cmdline").alias("id"))
        .distinct()
        .select("id", F.array(*[F.pmod(F.col("id"), F.lit(p)) / p for p in (7, 11, 13, 17)]).alias("vec"))
    )
    hosts = studies.host_times(runs, vectors, opts, origin=inputs.TEST_ORIGIN)
    rows = hosts["map_table"].collect()
    assert rows and all(0 <= r["colour"] <= 1 for r in rows)
    assert all(r["label"] for r in rows)
    assert hosts["paths"].filter("from_x IS NOT NULL").count() > 0

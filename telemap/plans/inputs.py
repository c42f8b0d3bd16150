"""The test tables in the shapes the operators take, as DataFrames and as SQL.

Events play processes, customers with their nations and regions play process
trees, line items play image loads, documents play free-text command lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemap.operators import curate
from telemap.session import spread
from telemap.sources import read_source

# Agent marks and period start for the test tables.
TEST_MARKS = ("NATION_1>", "NATION_7>")
TEST_START = "2024-01-03 00:00:00"
TEST_ORIGIN = "2024-01-03 02:00:00"


def process(spark: SparkSession, folder: str) -> DataFrame:
    return as_process(read_source(spark, folder, "events"))


def as_process(events: DataFrame) -> DataFrame:
    """Events as raw processes; an ``error`` event was seen an hour earlier already."""
    seen = F.when(
        F.col("event_type") == "error", F.col("ts") - F.expr("interval 1 hour")
    ).otherwise(F.col("ts"))
    return events.select(
        F.col("event_id").cast("string").alias("pid_hash"),
        F.when(F.col("event_id") >= 10, F.expr("event_id div 10").cast("string")).alias(
            "parent_pid_hash"
        ),
        F.col("ts").alias("process_started"),
        seen.alias("first_seen"),
        F.concat(F.lit("HOST-"), F.col("user_id").cast("string")).alias("hostname"),
        F.concat(F.col("event_type"), F.lit(".exe")).alias("process_name"),
        F.concat(F.lit("c:\\bin\\"), F.col("event_type"), F.lit(".exe")).alias("process_path"),
        F.nullif(F.col("props"), F.lit('{"k": 0}')).alias("args"),
    )


PROCESS_SQL = r"""
    process AS (
      SELECT CAST(event_id AS VARCHAR) AS pid_hash,
             CASE WHEN event_id >= 10 THEN CAST(event_id // 10 AS VARCHAR) END AS parent_pid_hash,
             ts AS process_started,
             CASE WHEN event_type = 'error' THEN ts - INTERVAL 1 HOUR ELSE ts END AS first_seen,
             'HOST-' || user_id AS hostname,
             event_type || '.exe' AS process_name,
             'c:\bin\' || event_type || '.exe' AS process_path,
             nullif(props, '{"k": 0}') AS args
      FROM events)"""


def process_path(spark: SparkSession, folder: str) -> DataFrame:
    """Tree path of each process: region, nation and customer of its user."""
    events = read_source(spark, folder, "events").select("event_id", "user_id")
    customer = read_source(spark, folder, "customer")
    nation = read_source(spark, folder, "nation")
    region = read_source(spark, folder, "region")
    trees = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("c_custkey", F.concat_ws(">", "r_name", "n_name", "c_name").alias("ptree"))
    )
    return events.join(trees, events.user_id == trees.c_custkey).select(
        F.col("event_id").cast("string").alias("pid_hash"), "ptree"
    )


PROCESS_PATH_SQL = """
    process_path AS (
      SELECT CAST(event_id AS VARCHAR) AS pid_hash,
             r_name || '>' || n_name || '>' || c_name AS ptree
      FROM events
      JOIN customer ON user_id = c_custkey
      JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey)"""


def process_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return curate.curate(
        process(spark, folder), process_path(spark, folder), TEST_MARKS, TEST_START
    )


PROCESS_FILTERED_SQL = (
    PROCESS_SQL
    + ","
    + PROCESS_PATH_SQL
    + r""",
    process_filtered AS (
      SELECT p.pid_hash, p.parent_pid_hash, p.process_started AS "timestamp", p.hostname,
             p.process_name AS name,
             trim('"' || p.process_path || '" ' || coalesce(p.args, '')) AS cmdline, pp.ptree
      FROM process p JOIN process_path pp USING (pid_hash)
      WHERE pp.ptree NOT LIKE '%NATION_1>%' AND pp.ptree NOT LIKE '%NATION_7>%'
        AND p.process_started >= TIMESTAMP '2024-01-03 00:00:00'
        AND p.process_started = p.first_seen)"""
)


def all_processes(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a curated process, without the filters."""
    return curate.select_process(process(spark, folder))


ALL_PROCESSES_SQL = (
    PROCESS_SQL
    + r""",
    processes AS (
      SELECT pid_hash, parent_pid_hash, process_started AS "timestamp", hostname,
             process_name AS name,
             trim('"' || process_path || '" ' || coalesce(args, '')) AS cmdline
      FROM process)"""
)


def process_image_load(spark: SparkSession, folder: str) -> DataFrame:
    return read_source(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("pid_hash"),
        F.concat(F.lit("c:\\lib\\part"), F.col("l_partkey").cast("string"), F.lit(".dll")).alias(
            "filename"
        ),
        F.col("l_shipdate").alias("first_seen"),
    )


IMAGE_LOAD_SQL = r"""
    process_image_load AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS pid_hash,
             'c:\lib\part' || l_partkey || '.dll' AS filename, l_shipdate AS first_seen
      FROM lineitem)"""


def order_processes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as the processes the image loads belong to."""
    return read_source(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("pid_hash"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderpriority").alias("name"),
        "o_orderstatus",
    )


def item_bag(spark: SparkSession, folder: str) -> DataFrame:
    """Order x part counts."""
    from telemap.operators import bags

    lines = read_source(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    return bags.bag_of_pairs(lines, "l_orderkey", "l_partkey")


ITEM_BAG_SQL = """
    bag AS (
      SELECT l_orderkey AS row_id, l_partkey AS col_id, count(*) AS n
      FROM lineitem GROUP BY 1, 2)"""


def document_tokens(spark: SparkSession, folder: str, together: bool = False) -> DataFrame:
    """Tokens of all documents; ``together`` deals them by document first.

    What is grouped by document later then needs no shuffle of tokens.
    """
    from telemap.functions.text import tokenize

    docs = read_source(spark, folder, "documents").select("doc_id", "text")
    docs = docs.repartition("doc_id") if together else spread(docs)
    return tokenize(docs, "text").select("doc_id", "tokens")


def document_bag(spark: SparkSession, folder: str) -> DataFrame:
    from telemap.operators import bags

    return bags.bag(document_tokens(spark, folder, together=True), "doc_id", "tokens")


TOKEN_PATTERN_SQL = (
    r"""'"[^"]*"|''[^'']*''|[^ \t\r\n"''][^ \t\r\n]*|["''][\s\S]*'"""
)


def tokens_sql(text: str) -> str:
    """SQL for the shell tokens of ``text``, with the open-quote repair."""
    split = f"regexp_extract_all({text}, {TOKEN_PATTERN_SQL})"
    again = f"regexp_extract_all({text} || '\" <broken>', {TOKEN_PATTERN_SQL})"
    return (
        f"CASE WHEN NOT {_open_sql(split)} THEN {split} "
        f"WHEN NOT {_open_sql(again)} THEN {again} END"
    )


def _open_sql(tokens: str) -> str:
    last = f"coalesce(({tokens})[-1], '')"
    return (
        f"(left({last}, 1) IN ('\"', '''') AND "
        f"strpos(substr({last}, 2), left({last}, 1)) = 0)"
    )


DOCUMENT_TOKENS_SQL = f"""
    tokens AS (
      SELECT doc_id, {tokens_sql("text")} AS tokens FROM documents)"""

DOCUMENT_BAG_SQL = (
    DOCUMENT_TOKENS_SQL
    + """,
    bag AS (
      SELECT doc_id AS row_id, token AS col_id, count(*) AS n
      FROM (SELECT doc_id, unnest(tokens) AS token FROM tokens) GROUP BY 1, 2)"""
)

WEIGHTS_SQL = """
    rs AS (SELECT row_id, sum(n) AS r FROM bag GROUP BY 1),
    cs AS (SELECT col_id, sum(n) AS c FROM bag GROUP BY 1),
    tot AS (SELECT sum(n) AS t FROM bag),
    weights AS (
      SELECT b.col_id,
             greatest(sum((n / c) * log2((n / c) / (r / CAST(t AS DOUBLE)))), 0.0) AS bits
      FROM bag b JOIN rs USING (row_id) JOIN cs ON b.col_id = cs.col_id, tot
      GROUP BY 1),
    wbag AS (
      SELECT row_id, b.col_id, n * bits AS w FROM bag b JOIN weights w ON b.col_id = w.col_id)"""


def host_instances(spark: SparkSession, folder: str) -> DataFrame:
    """Every process with its command-line object, host and 3 h bin."""
    from telemap.operators import bags, hosttime

    processes = all_processes(spark, folder).withColumn(
        "obj_id", bags.object_id(F.col("cmdline"))
    )
    binned = hosttime.time_bin(processes, origin=TEST_ORIGIN)
    return binned.withColumn("row_id", hosttime.host_time_id(F.col("hostname"), F.col("bin")))


HOST_INSTANCES_SQL = (
    ALL_PROCESSES_SQL
    + """,
    instances AS (
      SELECT *, time_bucket(INTERVAL 3 HOUR, "timestamp", TIMESTAMP '2024-01-03 02:00:00') AS bin,
             hostname || '|' || strftime(
               time_bucket(INTERVAL 3 HOUR, "timestamp", TIMESTAMP '2024-01-03 02:00:00'),
               '%Y-%m-%d %H:%M:%S') AS row_id
      FROM processes)"""
)

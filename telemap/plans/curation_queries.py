"""Queries over sources, curation, scalar functions and stage hand-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemap.functions import text as fx
from telemap.operators import bags, curate, hosttime
from telemap.plans import Registry, inputs
from telemap.session import scratch_path
from telemap.sources import (
    load_dictionary,
    load_stage,
    load_triples,
    load_vectors,
    read_source,
    register_views,
    save_dictionary,
    save_stage,
    save_triples,
    save_vectors,
    schemas,
)

REGISTRY = Registry()
query = REGISTRY.query


def micros(col: str | Column) -> Column:
    return F.unix_micros(col)


@query("SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def scan_source(spark: SparkSession, folder: str) -> DataFrame:
    """Scan a Parquet source."""
    return (
        read_source(spark, folder, "orders")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))
    )


@query(
    """SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
       GROUP BY n_name"""
)
def sql_over_views(spark: SparkSession, folder: str) -> DataFrame:
    """SQL text over registered views."""
    register_views(spark, folder, ["customer", "nation"])
    return spark.sql(
        """SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
           GROUP BY n_name"""
    )


_FILTERED_COLUMNS = """SELECT pid_hash, parent_pid_hash, epoch_us("timestamp") AS ts_us, hostname,
    name, cmdline, ptree FROM process_filtered"""


def _with_micros(df: DataFrame) -> DataFrame:
    return df.select(
        *[micros(c).alias("ts_us") if c == "timestamp" else F.col(c) for c in df.columns]
    )


@query(f"WITH {inputs.PROCESS_FILTERED_SQL} {_FILTERED_COLUMNS}")
def curate_processes(spark: SparkSession, folder: str) -> DataFrame:
    """The curation query."""
    return _with_micros(curate.order_processes(inputs.process_filtered(spark, folder)))


@query(
    f"""WITH {inputs.PROCESS_SQL}
        SELECT pid_hash, parent_pid_hash, epoch_us(process_started) AS ts_us, hostname,
               process_name AS name,
               trim('"' || process_path || '" ' || coalesce(args, '')) AS cmdline
        FROM process"""
)
def select_process(spark: SparkSession, folder: str) -> DataFrame:
    """Projection and renaming, command line put together."""
    return _with_micros(curate.select_process(inputs.process(spark, folder)))


@query(
    f"""WITH {inputs.PROCESS_PATH_SQL}
        SELECT pid_hash, ptree FROM process_path
        WHERE ptree NOT LIKE '%NATION_1>%' AND ptree NOT LIKE '%NATION_7>%'"""
)
def exclude_subtrees(spark: SparkSession, folder: str) -> DataFrame:
    """Drop activity under marked subtrees."""
    return curate.exclude_subtrees(
        inputs.process_path(spark, folder), "ptree", inputs.TEST_MARKS
    )


@query(
    f"""WITH {inputs.PROCESS_SQL}
        SELECT hostname, count(*) AS n, min(epoch_us(process_started)) AS first_us
        FROM process WHERE process_started >= TIMESTAMP '2024-01-03 00:00:00' GROUP BY 1"""
)
def in_period(spark: SparkSession, folder: str) -> DataFrame:
    """Rows from the capture period on."""
    kept = curate.in_period(
        inputs.process(spark, folder), "process_started", inputs.TEST_START
    )
    return kept.groupBy("hostname").agg(
        F.count(F.lit(1)).alias("n"), F.min(micros("process_started")).alias("first_us")
    )


@query(
    f"""WITH {inputs.PROCESS_SQL}
        SELECT process_name, count(*) AS n FROM process
        WHERE process_started = first_seen GROUP BY 1"""
)
def first_sightings(spark: SparkSession, folder: str) -> DataFrame:
    """P5: first sightings only."""
    kept = curate.first_sightings(inputs.process(spark, folder))
    return kept.groupBy("process_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {inputs.IMAGE_LOAD_SQL}
        SELECT pid_hash, filename, epoch_us(first_seen) AS ts_us FROM process_image_load
        WHERE pid_hash IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders
                           WHERE o_orderstatus <> 'P')"""
)
def image_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Image loads of kept processes."""
    kept = inputs.order_processes(spark, folder).filter("o_orderstatus <> 'P'")
    loads = curate.select_image_loads(inputs.process_image_load(spark, folder))
    return _with_micros(curate.order_loads(curate.loads_of(loads, kept)))


@query(
    f"""WITH {inputs.PROCESS_SQL}, {inputs.PROCESS_PATH_SQL}
        SELECT hostname, ptree, count(*) AS n
        FROM process JOIN process_path USING (pid_hash) GROUP BY 1, 2"""
)
def with_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Processes with their tree path."""
    joined = curate.with_tree(inputs.process(spark, folder), inputs.process_path(spark, folder))
    return joined.groupBy("hostname", "ptree").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, event_type FROM events")
def narrow_columns(spark: SparkSession, folder: str) -> DataFrame:
    """P10: column pruning before a heavy step."""
    return curate.narrow(
        read_source(spark, folder, "events"), ["event_id", "user_id", "event_type"]
    )


@query(
    f"""WITH {inputs.ALL_PROCESSES_SQL}
        SELECT pid_hash, parent_pid_hash, cmdline FROM processes
        WHERE parent_pid_hash IS NOT NULL AND cmdline IS NOT NULL"""
)
def drop_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Drop rows with missing values."""
    rows = inputs.all_processes(spark, folder).select("pid_hash", "parent_pid_hash", "cmdline")
    return curate.drop_missing(rows, ["parent_pid_hash", "cmdline"])


@query(
    f"""WITH {inputs.ALL_PROCESSES_SQL},
        firsts AS (SELECT arg_min(pid_hash, ("timestamp", pid_hash)) AS pid_hash
                   FROM processes GROUP BY cmdline)
        SELECT pid_hash, hostname, name, cmdline FROM processes
        WHERE pid_hash IN (SELECT pid_hash FROM firsts)"""
)
def first_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Process metadata restricted to the first instance of each command line."""
    processes = inputs.all_processes(spark, folder)
    uniq = bags.uniques(processes, "cmdline", "pid_hash", ["timestamp"])
    return curate.restrict_to(
        processes, uniq.select(F.col("first_key").alias("pid_hash")), "pid_hash"
    ).select("pid_hash", "hostname", "name", "cmdline")


@query(
    f"""WITH {inputs.DOCUMENT_TOKENS_SQL}
        SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, chr(31)) AS joined
        FROM tokens WHERE tokens IS NOT NULL"""
)
def tokenize_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Shell tokens of every document."""
    return inputs.document_tokens(spark, folder).filter("tokens IS NOT NULL").select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.array_join("tokens", "\x1f").alias("joined"),
    )


@query(
    f"""WITH {inputs.ALL_PROCESSES_SQL}
        SELECT DISTINCT cmdline, array_to_string({inputs.tokens_sql("cmdline")}, chr(31)) AS joined
        FROM processes"""
)
def tokenize_cmdlines(spark: SparkSession, folder: str) -> DataFrame:
    """F2 on command lines, one split per unique line."""
    lines = inputs.all_processes(spark, folder).select("cmdline").distinct()
    return fx.tokenize(lines, "cmdline").select(
        "cmdline", F.array_join("tokens", "\x1f").alias("joined")
    )


@query(
    """WITH u AS (SELECT text, count(*) AS n FROM documents GROUP BY 1),
       h AS (SELECT CASE WHEN n > 1 THEN '(' || n || 'x) ' ELSE '' END || text AS whole FROM u)
       SELECT CASE WHEN length(whole) > 100 THEN substr(whole, 1, 100) || '[...]' ELSE whole END
              AS hover_text FROM h"""
)
def hover_texts(spark: SparkSession, folder: str) -> DataFrame:
    """hover text with the multiplicity in front."""
    uniq = bags.uniques(read_source(spark, folder, "documents"), "text", "doc_id")
    return uniq.select(fx.hover_text(F.col("n"), F.col("obj")).alias("hover_text"))


@query(
    r"""SELECT page_id, list_extract(string_split(replace(url, '/', '\'), '\'), -1) AS base
        FROM pages"""
)
def base_names(spark: SparkSession, folder: str) -> DataFrame:
    """text after the last separator."""
    path = F.translate("url", "/", "\\")
    return read_source(spark, folder, "pages").select("page_id", fx.base_name(path).alias("base"))


@query(
    f"""WITH {inputs.ALL_PROCESSES_SQL}
        SELECT pid_hash, name || array_to_string(string_split(cmdline, '"')[3:], '"') AS line
        FROM processes"""
)
def args_of(spark: SparkSession, folder: str) -> DataFrame:
    """program name and arguments without the quoted path."""
    return inputs.all_processes(spark, folder).select(
        "pid_hash", fx.args_of(F.col("cmdline"), F.col("name")).alias("line")
    )


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL}
        SELECT DISTINCT row_id, hostname || ', ' || strftime(bin - INTERVAL 5 HOUR, '%b %d, %H:%M')
               AS hover_text
        FROM instances"""
)
def host_time_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Host and local time of every host-time."""
    return (
        inputs.host_instances(spark, folder)
        .select("row_id", fx.host_time_text(F.col("hostname"), F.col("bin")).alias("hover_text"))
        .distinct()
    )


@query(
    """SELECT event_type, printf('%s %.1f', event_type, avg(value)) AS line,
              printf('%s %.1f', event_type, round(sum(value) / 64) / 64) AS dyadic
       FROM events GROUP BY 1"""
)
def bits_text(spark: SparkSession, folder: str) -> DataFrame:
    """F8: name with a number to one decimal."""
    sums = read_source(spark, folder, "events").groupBy("event_type").agg(
        F.avg("value").alias("m"), (F.round(F.sum("value") / 64) / 64).alias("d")
    )
    return sums.select(
        "event_type",
        fx.bits_text(F.col("event_type"), F.col("m")).alias("line"),
        fx.bits_text(F.col("event_type"), F.col("d")).alias("dyadic"),
    )


@query(
    """WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS n,
                         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus) AS r,
                         dense_rank() OVER (ORDER BY l_returnflag) - 1 AS cluster
                  FROM lineitem GROUP BY 1, 2)
       SELECT l_returnflag,
              string_agg(CASE WHEN n > 10000 THEN '>' ELSE '<' END || l_linestatus, chr(10)
                         ORDER BY r) || repeat(chr(8237), CAST(max(cluster) AS INTEGER)) AS label
       FROM s GROUP BY 1"""
)
def label_text(spark: SparkSession, folder: str) -> DataFrame:
    """Signed lines joined into one label per group, kept distinct."""
    flags = ["A", "N", "R"]
    counts = read_source(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n")
    )
    line = F.concat(fx.gap_sign(F.col("n"), F.lit(10000)), F.col("l_linestatus"))
    parts = counts.groupBy("l_returnflag").agg(
        F.collect_list(F.struct(F.col("l_linestatus").alias("rank"), line.alias("text"))).alias("p")
    )
    cluster = F.array_position(F.array(*[F.lit(f) for f in flags]), F.col("l_returnflag")) - 1
    return parts.select(
        "l_returnflag", fx.unique_label(fx.join_lines(F.col("p")), cluster).alias("label")
    )


@query(f"WITH {inputs.PROCESS_FILTERED_SQL} {_FILTERED_COLUMNS}")
def stage_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Write a stage as zstd Parquet and read it back with its schema."""
    path = scratch_path(spark, "process_filtered")
    save_stage(inputs.process_filtered(spark, folder), path, ["timestamp", "hostname"])
    return _with_micros(load_stage(spark, path, schemas.PROCESS_FILTERED))


@query(f"WITH {inputs.ITEM_BAG_SQL} SELECT row_id, col_id, n FROM bag")
def triples_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A sparse matrix as a table."""
    path = scratch_path(spark, "triples")
    save_triples(inputs.item_bag(spark, folder), path)
    return load_triples(spark, path)


@query(
    """SELECT vec_id AS id, len(embedding) AS width,
              round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v)), 6) AS total
       FROM embeddings"""
)
def vectors_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Dense rows as a table."""
    path = scratch_path(spark, "vectors")
    rows = read_source(spark, folder, "embeddings")
    save_vectors(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), path)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v)
    return load_vectors(spark, path).select(
        "id", F.size("vec").cast("long").alias("width"), F.round(total, 6).alias("total")
    )


_TOP_EVENTS_SQL = """
    top AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1
            ORDER BY n DESC, label LIMIT 3),
    dictionary AS (
      SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS rank FROM top
      UNION ALL SELECT 'Unlabelled', count(*) FROM top)"""


@query(f"WITH {_TOP_EVENTS_SQL} SELECT label, CAST(rank AS BIGINT) AS rank FROM dictionary")
def dictionary_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The label dictionary as JSON lines."""
    from telemap.operators import maps

    path = scratch_path(spark, "dictionary")
    top = bags.top_values(read_source(spark, folder, "events"), "event_type", 3)
    save_dictionary(maps.label_dictionary(top, "event_type"), path)
    return load_dictionary(spark, path)


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL}
        SELECT epoch_us(bin) AS bin_us, hostname,
               CAST(row_number() OVER (ORDER BY bin, hostname) - 1 AS BIGINT) AS row_number
        FROM (SELECT DISTINCT bin, hostname FROM instances)"""
)
def number_host_times(spark: SparkSession, folder: str) -> DataFrame:
    """O3: host-times numbered in (bin, host) order."""
    numbered = hosttime.number_host_times(inputs.host_instances(spark, folder))
    return numbered.select(micros("bin").alias("bin_us"), "hostname", "row_number")

"""Queries over unique objects, bags, weights, co-occurrence and host-times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemap.operators import bags, cooccurrence, hosttime, weights
from telemap.operators.neighbors import disconnected_rows
from telemap.plans import Registry, inputs
from telemap.session import cut
from telemap.sources import read_source

REGISTRY = Registry()
query = REGISTRY.query


@query(
    f"""WITH {inputs.ALL_PROCESSES_SQL}
        SELECT cmdline AS obj, arg_min(pid_hash, ("timestamp", pid_hash)) AS first_key,
               count(*) AS n
        FROM processes WHERE cmdline IS NOT NULL GROUP BY 1"""
)
def unique_cmdlines(spark: SparkSession, folder: str) -> DataFrame:
    """A1: distinct command lines with first instance and multiplicity."""
    uniq = bags.uniques(
        inputs.all_processes(spark, folder), "cmdline", "pid_hash", ["timestamp"]
    )
    return uniq.select("obj", "first_key", "n")


@query(
    f"""WITH {inputs.ALL_PROCESSES_SQL},
        u AS (SELECT cmdline, count(*) AS n FROM processes GROUP BY 1)
        SELECT pid_hash, cmdline AS obj, n FROM processes JOIN u USING (cmdline)"""
)
def deunique_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per-object results carried back to instances."""
    processes = inputs.all_processes(spark, folder)
    uniq = bags.uniques(processes, "cmdline", "pid_hash", ["timestamp"])
    members = bags.membership(processes, "cmdline", "pid_hash")
    return bags.deunique(members, uniq).select("pid_hash", "obj", "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A3: value counts."""
    return bags.value_counts(read_source(spark, folder, "events"), "event_type")


@query("SELECT props, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, props LIMIT 25")
def top_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A4: the 25 most frequent values."""
    return bags.top_values(read_source(spark, folder, "events"), "props", 25)


@query(
    """WITH top AS (SELECT props, count(*) AS n FROM events GROUP BY 1
                    ORDER BY n DESC, props LIMIT 25)
       SELECT e.event_id, coalesce(t.props, 'Unlabelled') AS label
       FROM events e LEFT JOIN top t ON e.props = t.props"""
)
def bucket_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Rare labels folded into one bucket."""
    events = read_source(spark, folder, "events").select("event_id", "props")
    top = bags.top_values(events, "props", 25)
    return bags.bucket_labels(events, "props", top).select("event_id", "label")


@query("SELECT DISTINCT source FROM documents")
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    """A5: distinct values."""
    return bags.distinct_values(read_source(spark, folder, "documents"), "source")


@query(
    f"""WITH {inputs.IMAGE_LOAD_SQL}
        SELECT pid_hash, CAST(0 AS BIGINT) AS part, count(*) AS n_items,
               string_agg(filename, chr(10) ORDER BY filename) AS items
        FROM process_image_load GROUP BY 1"""
)
def collect_items(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted item list per key."""
    lists = bags.collect_items(inputs.process_image_load(spark, folder), "pid_hash", "filename")
    return lists.select(
        "pid_hash",
        "part",
        F.size("items").cast("long").alias("n_items"),
        F.array_join("items", "\n").alias("items"),
    )


@query(
    """SELECT o_orderkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_items, min(o_orderpriority) AS name
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
)
def attach_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Item lists with process metadata."""
    lists = (
        inputs.item_bag(spark, folder)
        .groupBy(F.col("row_id").cast("string").alias("pid_hash"))
        .agg(F.count(F.lit(1)).alias("n_items"))
    )
    meta = inputs.order_processes(spark, folder).select("pid_hash", "name")
    return bags.attach_metadata(lists, meta).select(
        F.col("pid_hash").cast("long").alias("o_orderkey"), "n_items", "name"
    )


@query(
    """SELECT count(*) AS n_objects,
              count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
              AS n_without_items
       FROM orders"""
)
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Objects without recorded items."""
    return bags.coverage(
        inputs.order_processes(spark, folder).select("pid_hash"),
        inputs.process_image_load(spark, folder),
    )


@query(f"WITH {inputs.DOCUMENT_BAG_SQL} SELECT row_id, col_id, n FROM bag")
def token_bag(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts per document."""
    return inputs.document_bag(spark, folder)


_BIGRAMS_SQL = f"""WITH {inputs.DOCUMENT_TOKENS_SQL},
    pairs AS (
      SELECT doc_id AS row_id,
             unnest(list_transform(range(1, len(tokens)),
                                   lambda i: tokens[i] || ' ' || tokens[i + 1])) AS col_id
      FROM tokens)
    SELECT row_id, count(*) AS n_pairs, count(DISTINCT col_id) AS n_distinct
    FROM pairs GROUP BY 1"""


@query(_BIGRAMS_SQL)
def ngram_bag(spark: SparkSession, folder: str) -> DataFrame:
    """A7 with runs of two tokens."""
    grams = bags.bag_of_ngrams(inputs.document_tokens(spark, folder, together=True), "doc_id", "tokens", 2)
    return grams.groupBy("row_id").agg(
        F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_distinct")
    )


@query(
    f"""WITH {inputs.DOCUMENT_BAG_SQL}
        SELECT count(DISTINCT row_id) AS n_rows, count(DISTINCT col_id) AS n_cols,
               count(*) AS n_nonzero, CAST(sum(n) AS BIGINT) AS total FROM bag"""
)
def bag_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Bag shape."""
    return bags.bag_stats(inputs.document_bag(spark, folder))


@query(
    f"""WITH {inputs.ITEM_BAG_SQL}
        SELECT col_id, CAST(row_number() OVER (ORDER BY col_id) - 1 AS BIGINT) AS idx
        FROM (SELECT DISTINCT col_id FROM bag)"""
)
def token_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Columns numbered in order."""
    return bags.token_dictionary(inputs.item_bag(spark, folder))


@query(
    f"""WITH {inputs.ITEM_BAG_SQL},
        dictionary AS (SELECT col_id, row_number() OVER (ORDER BY col_id) - 1 AS idx
                       FROM (SELECT DISTINCT col_id FROM bag)),
        coded AS (SELECT row_id, idx, n FROM bag JOIN dictionary USING (col_id))
        SELECT row_id, col_id, n FROM coded JOIN dictionary USING (idx)"""
)
def lookup_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Column numbers back to columns."""
    bag = inputs.item_bag(spark, folder)
    dictionary = bags.token_dictionary(bag)
    coded = bag.join(dictionary, "col_id").select("row_id", "idx", "n")
    return bags.lookup_tokens(coded, dictionary).select("row_id", "col_id", "n")


@query(
    f"""WITH {inputs.ITEM_BAG_SQL}, {inputs.WEIGHTS_SQL}
        SELECT col_id, round(bits, 6) + 0.0 AS bits FROM weights"""
)
def info_weights(spark: SparkSession, folder: str) -> DataFrame:
    """V1: bits per item."""
    w = weights.information_weights(inputs.item_bag(spark, folder))
    return w.select("col_id", (F.round("bits", 6) + 0.0).alias("bits"))


@query(
    f"""WITH {inputs.ITEM_BAG_SQL}, {inputs.WEIGHTS_SQL},
        mixed AS (
          SELECT b.col_id, c, r / CAST(t AS DOUBLE) AS share,
                 (n + 0.5 * r / CAST(t AS DOUBLE)) / (c + 0.5) AS p
          FROM bag b JOIN rs USING (row_id) JOIN cs ON b.col_id = cs.col_id, tot)
        SELECT col_id, round(greatest(
                 sum(p * log2(p / share))
                 + (1 - sum(share)) * 0.5 / (any_value(c) + 0.5)
                   * log2(0.5 / (any_value(c) + 0.5)), 0.0), 6) + 0.0 AS bits
        FROM mixed GROUP BY 1"""
)
def info_weights_prior(spark: SparkSession, folder: str) -> DataFrame:
    """V1 with a prior."""
    w = weights.information_weights(inputs.item_bag(spark, folder), prior=0.5)
    return w.select("col_id", (F.round("bits", 6) + 0.0).alias("bits"))


@query(
    f"""WITH {inputs.DOCUMENT_BAG_SQL}, {inputs.WEIGHTS_SQL}
        SELECT row_id, count(*) AS n_cols, round(sum(w), 4) + 0.0 AS bits FROM wbag GROUP BY 1"""
)
def reweighted_docs(spark: SparkSession, folder: str) -> DataFrame:
    """V1: counts to bits, summed per document."""
    wbag = weights.information_bag(inputs.document_bag(spark, folder))
    return wbag.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_cols"), (F.round(F.sum("w"), 4) + 0.0).alias("bits")
    )


@query(
    f"""WITH {inputs.ITEM_BAG_SQL}, {inputs.WEIGHTS_SQL}
        SELECT row_id, col_id, round(w, 6) + 0.0 AS w FROM wbag"""
)
def reweighted_bag(spark: SparkSession, folder: str) -> DataFrame:
    """V1: the reweighted bag itself."""
    bag = inputs.item_bag(spark, folder)
    wbag = weights.reweight(bag, weights.information_weights(bag))
    return wbag.select("row_id", "col_id", (F.round("w", 6) + 0.0).alias("w"))


@query(
    f"""WITH {inputs.ITEM_BAG_SQL}, {inputs.WEIGHTS_SQL}
        SELECT col_id, round(sum(w), 5) + 0.0 AS total FROM wbag GROUP BY 1"""
)
def col_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Column totals of a weighted bag."""
    bag = inputs.item_bag(spark, folder)
    wbag = weights.reweight(bag, weights.information_weights(bag))
    return bags.col_totals(wbag).select("col_id", (F.round("total", 5) + 0.0).alias("total"))


@query(
    f"""WITH {inputs.DOCUMENT_TOKENS_SQL},
        longt AS (SELECT doc_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM tokens),
        pairs AS (
          SELECT a.tok AS c1, b.tok AS c2, b.i - a.i AS d
          FROM longt a JOIN (SELECT *, unnest([1, 2, 3, 4, 5]) AS back FROM longt) b
            ON a.doc_id = b.doc_id AND a.i = b.i - b.back)
        SELECT c1, c2, CAST(count(*) AS DOUBLE) AS w, round(sum(1.0 / d), 6) AS harmonic
        FROM pairs GROUP BY 1, 2"""
)
def windowed_cooc(spark: SparkSession, folder: str) -> DataFrame:
    """V2: ordered co-occurrence within five places, flat and harmonic kernels."""
    tokens = inputs.document_tokens(spark, folder)
    both = cooccurrence.windowed_cooccurrence(tokens, kernel=("flat", "harmonic"))
    return both.select("c1", "c2", F.col("flat").alias("w"), F.round("harmonic", 6).alias("harmonic"))


_TALK_TOKENS_SQL = f"""
    tokens AS (SELECT conv_id, turn, {inputs.tokens_sql("text")} AS tokens FROM conversations),
    longt AS (SELECT conv_id, turn, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM tokens),
    pairs AS (
      SELECT a.conv_id, a.turn, a.i, a.tok AS c1, b.tok AS c2
      FROM longt a JOIN (SELECT *, unnest([1, 2, 3, 4, 5]) AS back FROM longt) b
        ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.i = b.i - b.back),
    t0 AS (SELECT c1, c2, CAST(count(*) AS DOUBLE) AS w FROM pairs GROUP BY 1, 2)"""


def _pass_sql(i: int) -> str:
    return f"""
    p{i} AS (SELECT c1, c2, w / sum(w) OVER (PARTITION BY c1) AS p FROM t{i}),
    z{i} AS (SELECT c1, c2, p / sum(p) OVER (PARTITION BY conv_id, turn, i) AS z
             FROM pairs JOIN p{i} USING (c1, c2)),
    t{i + 1} AS (SELECT c1, c2, sum(z) AS w FROM z{i} GROUP BY 1, 2)"""


@query(
    f"""WITH {_TALK_TOKENS_SQL}, {_pass_sql(0)}, {_pass_sql(1)}, {_pass_sql(2)}
        SELECT c1, c2, round(w, 5) + 0.0 AS w FROM t3"""
)
def smooth_cooc(spark: SparkSession, folder: str) -> DataFrame:
    """V4: co-occurrence smoothed in three passes."""
    from telemap.functions.text import tokenize

    talk = tokenize(read_source(spark, folder, "conversations").select("text"), "text")
    table = cooccurrence.smooth_cooccurrence(talk, n_iter=3)
    return table.select("c1", "c2", (F.round("w", 5) + 0.0).alias("w"))


@query(
    f"""WITH {inputs.ITEM_BAG_SQL}, {inputs.WEIGHTS_SQL},
        s AS (SELECT col_id, sum(w) AS s FROM wbag GROUP BY 1)
        SELECT a.col_id AS c1, b.col_id AS c2, round(any_value(s) * sum(a.w * b.w), 3) + 0.0 AS w
        FROM wbag a JOIN wbag b ON a.row_id = b.row_id JOIN s ON s.col_id = a.col_id
        GROUP BY 1, 2"""
)
def bag_cooc(spark: SparkSession, folder: str) -> DataFrame:
    """V3: orderless, row-scaled co-occurrence."""
    bag = inputs.item_bag(spark, folder)
    wbag = weights.reweight(bag, weights.information_weights(bag))
    table = cooccurrence.bag_cooccurrence(wbag)
    return table.select("c1", "c2", (F.round("w", 3) + 0.0).alias("w"))


@query(
    f"""WITH {inputs.DOCUMENT_BAG_SQL},
        df AS (SELECT col_id, count(*) AS d FROM bag GROUP BY 1)
        SELECT row_id, max(d) = 1 AS disconnected FROM bag JOIN df USING (col_id) GROUP BY 1"""
)
def disconnected(spark: SparkSession, folder: str) -> DataFrame:
    """V8: rows that share no token with any other."""
    return disconnected_rows(inputs.document_bag(spark, folder))


@query(
    """WITH bag AS (SELECT event_id AS row_id, concat(user_id, ':', event_type, ':', CAST(ts AS DATE)) AS col_id FROM events),
            df AS (SELECT col_id, count(*) AS d FROM bag GROUP BY 1)
       SELECT row_id, max(d) = 1 AS disconnected FROM bag JOIN df USING (col_id) GROUP BY 1"""
)
def disconnected_events(spark: SparkSession, folder: str) -> DataFrame:
    """V8: events whose user did nothing else of that type on that day."""
    acts = F.concat_ws(":", "user_id", "event_type", F.to_date("ts")).alias("col_id")
    return disconnected_rows(read_source(spark, folder, "events").select(F.col("event_id").alias("row_id"), acts))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def multiplied_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that would multiply rows in a metadata join."""
    return bags.multiplied_rows(read_source(spark, folder, "lineitem"), "l_orderkey")


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL}
        SELECT pid_hash, hostname, epoch_us(bin) AS bin_us FROM instances
        WHERE "timestamp" >= TIMESTAMP '2024-01-03 02:00:00'"""
)
def time_bins(spark: SparkSession, folder: str) -> DataFrame:
    """3 h bins anchored at an origin, earlier rows rejected."""
    binned = hosttime.time_bin(
        inputs.all_processes(spark, folder),
        origin=inputs.TEST_ORIGIN,
        reject_before_origin=True,
    )
    return binned.select("pid_hash", "hostname", F.unix_micros("bin").alias("bin_us"))


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL}
        SELECT epoch_us(bin) AS bin_us, hostname, cmdline, count(*) AS n
        FROM instances GROUP BY 1, 2, 3"""
)
def host_time_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Object counts per host and bin, all hosts at once."""
    instances = inputs.host_instances(spark, folder)
    uniq = bags.uniques(instances, "cmdline", "pid_hash").select("obj_id", "obj")
    return bags.deunique(hosttime.host_time_counts(instances), uniq).select(
        F.unix_micros("bin").alias("bin_us"), "hostname", F.col("obj").alias("cmdline"), "n"
    )


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL}
        SELECT epoch_us(bin) AS bin_us, hostname, CAST(0 AS BIGINT) AS part,
               count(DISTINCT cmdline) AS n_objects, count(*) AS n_total,
               string_agg(pid_hash, ',' ORDER BY pid_hash) AS pids
        FROM instances GROUP BY 1, 2"""
)
def host_times(spark: SparkSession, folder: str) -> DataFrame:
    """A10: nested lists per host and bin."""
    nested = hosttime.host_times(inputs.host_instances(spark, folder))
    return nested.select(
        F.unix_micros("bin").alias("bin_us"),
        "hostname",
        "part",
        F.size("counts").cast("long").alias("n_objects"),
        F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + c["n"]).alias("n_total"),
        F.array_join("pids", ",").alias("pids"),
    )


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL}
        SELECT row_id, cmdline AS col_id, count(*) AS n FROM instances GROUP BY 1, 2"""
)
def edges_to_bag(spark: SparkSession, folder: str) -> DataFrame:
    """Nested counts exploded to edges and summed on a pinned column set."""
    instances = inputs.host_instances(spark, folder)
    edges = bags.explode_pairs(hosttime.host_times(instances), "counts", ["bin", "hostname"])
    edges = edges.withColumn("row_id", hosttime.host_time_id(F.col("hostname"), F.col("bin")))
    uniq = bags.uniques(instances, "cmdline", "pid_hash").select("obj_id", "obj")
    bag = bags.edges_to_bag(
        edges, ["row_id"], "obj_id", "n", uniq.select(F.col("obj_id").alias("col_id"))
    )
    return bag.join(uniq, bag.col_id == uniq.obj_id).select(
        "row_id", F.col("obj").alias("col_id"), "n"
    )


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL},
        bag AS (SELECT row_id, cmdline AS col_id, count(*) AS n FROM instances GROUP BY 1, 2),
        {inputs.WEIGHTS_SQL}
        SELECT row_id, col_id, round(w, 6) + 0.0 AS w FROM wbag"""
)
def host_time_weights(spark: SparkSession, folder: str) -> DataFrame:
    """V1 on host-times."""
    bag = bags.bag_of_pairs(inputs.host_instances(spark, folder), "row_id", "cmdline")
    wbag = weights.reweight(bag, weights.information_weights(bag))
    return wbag.select("row_id", "col_id", (F.round("w", 6) + 0.0).alias("w"))


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL}
        SELECT min(epoch_us(bin)) AS min_us, max(epoch_us(bin)) AS max_us,
               max(epoch_us(bin)) - min(epoch_us(bin)) AS span_micros FROM instances"""
)
def time_span(spark: SparkSession, folder: str) -> DataFrame:
    """First and last bin."""
    return hosttime.time_span(inputs.host_instances(spark, folder)).select(
        F.unix_micros("ts_min").alias("min_us"), F.unix_micros("ts_max").alias("max_us"), "span_micros"
    )


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL}, h AS (SELECT DISTINCT row_id, epoch_us(bin) AS b FROM instances)
        SELECT row_id, round((b - min(b) OVER ()) / CAST(max(b) OVER () - min(b) OVER () AS DOUBLE), 6)
               AS fraction FROM h"""
)
def time_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """Time scaled to [0, 1]."""
    rows = inputs.host_instances(spark, folder).select("row_id", "bin").distinct()
    return hosttime.time_fraction(rows).select("row_id", F.round("fraction", 6).alias("fraction"))


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL},
        h AS (SELECT hostname, bin, CAST(count(*) AS DOUBLE) AS x,
                     CAST(count(DISTINCT name) AS DOUBLE) AS y FROM instances GROUP BY 1, 2)
        SELECT hostname, epoch_us(bin) AS bin_us, x, y,
               lag(x) OVER w AS from_x, lag(y) OVER w AS from_y
        FROM h WINDOW w AS (PARTITION BY hostname ORDER BY bin)"""
)
def host_path(spark: SparkSession, folder: str) -> DataFrame:
    """A host's way over a map; here the map is (processes, names) per bin."""
    points = (
        inputs.host_instances(spark, folder)
        .groupBy("hostname", "bin", "name")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hostname", "bin")
        .agg(F.sum("n").cast("double").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    )
    return hosttime.host_path(points).select(
        "hostname", F.unix_micros("bin").alias("bin_us"), "x", "y", "from_x", "from_y"
    )

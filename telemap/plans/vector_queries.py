"""Queries over neighbours, embeddings, layouts and found clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemap import streaming
from telemap.functions.text import tokenize
from telemap.operators import (
    bags,
    cluster,
    cooccurrence,
    curate,
    layout,
    neighbors,
    reduce,
    transport,
    weights,
)
from telemap.plans import Registry, inputs
from telemap.plans.label_queries import document_wbag, item_wbag
from telemap.session import cut, scratch_path, spread
from telemap.sources import read_source

REGISTRY = Registry()
query = REGISTRY.query


def _hellinger_sql(k: int) -> str:
    return f"""
    p AS (SELECT row_id, col_id, sqrt(w / sum(w) OVER (PARTITION BY row_id)) AS v
          FROM wbag WHERE w > 0),
    pairs AS (SELECT a.row_id AS id, b.row_id AS neighbor,
                     round(sqrt(greatest(1 - sum(a.v * b.v), 0)), 9) AS dist
              FROM p a JOIN p b ON a.col_id = b.col_id AND a.row_id <> b.row_id GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbor) AS r FROM pairs)
    SELECT id, neighbor, round(dist, 6) + 0.0 AS dist FROM ranked WHERE r <= {k}"""


@query(f"WITH {inputs.ITEM_BAG_SQL}, {inputs.WEIGHTS_SQL}, {_hellinger_sql(15)}")
def knn_hellinger_items(spark: SparkSession, folder: str) -> DataFrame:
    """V6 on item bags."""
    return neighbors.knn_hellinger(item_wbag(spark, folder)).select(
        "id", "neighbor", (F.round("dist", 6) + 0.0).alias("dist")
    )


@query(f"WITH {inputs.DOCUMENT_BAG_SQL}, {inputs.WEIGHTS_SQL}, {_hellinger_sql(15)}")
def knn_hellinger_docs(spark: SparkSession, folder: str) -> DataFrame:
    """V6 on whole documents."""
    return neighbors.knn_hellinger(document_wbag(spark, folder)).select(
        "id", "neighbor", (F.round("dist", 6) + 0.0).alias("dist")
    )


@query(
    """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
       pairs AS (SELECT a.id, b.id AS neighbor, round(1 - list_cosine_similarity(a.v, b.v), 12) AS dist
                 FROM e a JOIN e b ON a.id <> b.id),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbor) AS r FROM pairs)
       SELECT id, neighbor, round(dist, 6) + 0.0 AS dist FROM ranked WHERE r <= 15"""
)
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """V7 V9: exact nearest vectors by cosine distance."""
    vectors = read_source(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )
    return neighbors.knn_cosine(vectors).select(
        "id", "neighbor", (F.round("dist", 6) + 0.0).alias("dist")
    )


@query(
    """WITH d AS (SELECT min(vec_id) AS id, count(*) AS n FROM embeddings GROUP BY embedding)
       SELECT id, n FROM d"""
)
def unique_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """V9: identical vectors merged."""
    vectors = read_source(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )
    uniques, members = neighbors.unique_vectors(vectors)
    counts = members.groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return uniques.join(counts, "id").select("id", "n")


def embedding_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_source(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )


def _listed(vectors: DataFrame, digits: int = 6) -> DataFrame:
    """Vectors as text of rounded numbers, one column."""
    text = F.array_join(
        F.transform("vec", lambda v: (F.round(v, digits) + 0.0).cast("string")), " "
    )
    return vectors.select("id", F.size("vec").cast("long").alias("width"), text.alias("vec"))


@query()
def svd_items(spark: SparkSession, folder: str) -> DataFrame:
    """V5: truncated SVD of the weighted item bag."""
    return _listed(reduce.truncated_svd(item_wbag(spark, folder), 16), 4)


def _squared(vectors: DataFrame) -> DataFrame:
    """Squared length of each vector."""
    total = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    return vectors.select("id", (F.round(total, 4) + 0.0).alias("squared"))


@query(
    """WITH m AS (SELECT user_id AS id, event_type, CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY 1, 2)
       SELECT id, round(sum(w * w), 4) + 0.0 AS squared FROM m GROUP BY 1"""
)
def svd_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """V5: a decomposition of full rank keeps the length of every row."""
    counts = read_source(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    triples = counts.select(
        F.col("user_id").alias("row_id"), F.col("event_type").alias("col_id"), F.col("n").cast("double").alias("w")
    )
    return _squared(reduce.truncated_svd(triples, 16))


@query(
    """SELECT vec_id AS id,
              round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v)), 4) + 0.0 AS squared
       FROM embeddings"""
)
def compressed_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """V5: turning vectors into all of their components keeps their length."""
    return _squared(reduce.compress(embedding_vectors(spark, folder), 64))


@query()
def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """V3 V5: item vectors from the co-occurrence matrix, which is never formed."""
    return _listed(reduce.item_vectors(item_wbag(spark, folder), 16), 2)


def token_vectors_of(tokens: DataFrame, k: int, n_iter: int) -> DataFrame:
    """A vector for every token, of lines of one token too."""
    table = cut(cooccurrence.smooth_cooccurrence(tokens, n_iter=n_iter))
    return reduce.token_vectors(table, k, tokens.select(F.explode("tokens").alias("token")))


@query()
def token_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """V2 V4 V5: token vectors from smoothed co-occurrence in conversations."""
    talk = tokenize(spread(read_source(spark, folder, "conversations").select("text")), "text")
    return _listed(token_vectors_of(talk.select("tokens"), 16, 3), 4)


@query()
def transport_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as distributions over token vectors."""
    tokens = cut(inputs.document_tokens(spark, folder))
    vectors = cut(token_vectors_of(tokens.select("tokens"), 16, 3))
    bag = bags.bag(tokens, "doc_id", "tokens")
    wbag = cut(weights.reweight(bag, weights.information_weights(bag), drop_zero=True))
    found = transport.transport_embedding(wbag, vectors)
    return _listed(_every(tokens.select(F.col("doc_id").alias("id")), found), 3)


def _every(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Results for every id; a row that no column tells apart has a null vector."""
    return ids.distinct().join(found, "id", "left")


def _cmdline_vectors(instances: DataFrame) -> DataFrame:
    """Vectors of unique command lines, by transport over token vectors."""
    uniq = bags.uniques(instances, "cmdline", "pid_hash", ["timestamp"])
    tokens = cut(tokenize(uniq, "obj").select("obj_id", "tokens").filter("tokens IS NOT NULL"))
    vectors = cut(token_vectors_of(tokens.select("tokens"), 16, 3))
    bag = bags.bag(tokens, "obj_id", "tokens")
    wbag = cut(weights.reweight(bag, weights.information_weights(bag), drop_zero=True))
    return transport.transport_embedding(wbag, vectors)


def _host_wbag(instances: DataFrame) -> DataFrame:
    bag = bags.bag_of_pairs(instances, "row_id", "obj_id")
    return weights.reweight(bag, weights.information_weights(bag), drop_zero=True)


@query()
def lift_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Host-times as distributions over command-line vectors."""
    instances = cut(inputs.host_instances(spark, folder))
    vectors = cut(_cmdline_vectors(instances))
    found = transport.lift(cut(_host_wbag(instances)), vectors)
    return _listed(_every(instances.select(F.col("row_id").alias("id")), found), 3)


_MEANS = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     dim AS (SELECT vec_id, unnest(range(len(v))) AS d, unnest(v) AS x FROM e),
     bag AS ({bag}),
     own AS (SELECT row_id, d, sum(w * x) / sum(w) AS m FROM bag JOIN dim ON col_id = vec_id GROUP BY 1, 2),
     mid AS (SELECT d, sum(w * x) / sum(w) AS m FROM bag JOIN dim ON col_id = vec_id GROUP BY 1)
"""


@query(
    _MEANS.format(bag="SELECT label AS row_id, vec_id AS col_id, 1.0 + vec_id % 5 AS w FROM embeddings")
    + "SELECT row_id AS id, d AS dim, round(own.m - mid.m, 6) + 0.0 AS moved FROM own JOIN mid USING (d)"
)
def transport_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Onto a cloud of one point a bag travels as its mean, taken from the mean of all."""
    vectors = cut(embedding_vectors(spark, folder))
    wbag = read_source(spark, folder, "embeddings").select(
        F.col("label").alias("row_id"), F.col("vec_id").alias("col_id"), (F.col("vec_id") % 5 + 1.0).alias("w")
    )
    rows = transport.transport_rows(cut(wbag), vectors, transport.reference_cloud(wbag, vectors, 1))
    return rows.select("id", F.posexplode("vec").alias("dim", "v")).select(
        "id", F.col("dim").cast("long").alias("dim"), (F.round("v", 6) + 0.0).alias("moved")
    )


@query(
    _MEANS.format(
        bag="""SELECT user_id AS row_id, event_id % (SELECT count(*) FROM embeddings) AS col_id, CAST(count(*) AS DOUBLE) AS w
               FROM events GROUP BY 1, 2"""
    )
    + "SELECT row_id AS id, round(sum((own.m - mid.m) ** 2), 5) + 0.0 AS squared FROM own JOIN mid USING (d) GROUP BY 1"
)
def lift_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Users lifted to the vectors of what they did, one reference point: the lengths stay as they are."""
    vectors = cut(embedding_vectors(spark, folder))
    events = read_source(spark, folder, "events")
    bag = events.groupBy(F.col("user_id").alias("row_id"), (F.col("event_id") % vectors.count()).alias("col_id"))
    wbag = cut(bag.agg(F.count(F.lit(1)).cast("double").alias("w")))
    lifted = transport.lift(wbag, vectors, n_ref=1, dim=64)
    total = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    return lifted.select("id", (F.round(total, 5) + 0.0).alias("squared"))


@query("SELECT count(*) AS rows, 15 * count(*) AS links, true AS enough FROM embeddings")
def knn_descent(spark: SparkSession, folder: str) -> DataFrame:
    """V7: neighbours by descent hold at least 95 of 100 of the exact ones."""
    vectors = cut(embedding_vectors(spark, folder))
    found = cut(neighbors.knn_cosine(vectors, 15, exact=False).select("id", "neighbor"))
    exact = neighbors.knn_cosine(vectors, 15).select("id", "neighbor", F.lit(1).alias("hit"))
    both = found.join(exact, ["id", "neighbor"], "left")
    links = F.count(F.lit(1))
    return both.agg(
        F.count_distinct("id").alias("rows"), links.alias("links"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.95 * links).alias("enough")
    )


@query()
def pca_start(spark: SparkSession, folder: str) -> DataFrame:
    """Start positions by principal components."""
    flat = reduce.pca_start(embedding_vectors(spark, folder))
    return flat.select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(
    """WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
       pairs AS (SELECT a.id, b.id AS neighbor, round(1 - list_cosine_similarity(a.v, b.v), 12) AS dist
                 FROM e a JOIN e b ON a.id <> b.id),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbor) AS r FROM pairs),
       knn AS (SELECT id, neighbor, dist FROM ranked WHERE r <= 15),
       near AS (SELECT id, list(dist ORDER BY dist) AS ds,
                       coalesce(min(dist) FILTER (WHERE dist > 0), 0.0) AS rho,
                       avg(dist) AS mean FROM knn GROUP BY 1),
       st AS (
         SELECT id, ds, rho, mean, CAST(0 AS DOUBLE) AS lo, CAST(-1 AS DOUBLE) AS hi,
                CAST(1 AS DOUBLE) AS mid, 0 AS step FROM near
         UNION ALL
         SELECT id, ds, rho, mean, lo2, hi2,
                CASE WHEN hi2 < 0 THEN lo2 * 2 ELSE (lo2 + hi2) / 2 END, step + 1
         FROM (SELECT *, CASE WHEN over_ THEN lo ELSE mid END AS lo2,
                      CASE WHEN over_ THEN mid ELSE hi END AS hi2
               FROM (SELECT *, list_sum(list_transform(ds, lambda d: exp(-greatest(d - rho, 0.0) / mid)))
                            > log2(15) AS over_ FROM st WHERE step < 64))),
       scales AS (SELECT id, rho, greatest(mid, mean * 1e-3, 1e-12) AS scale FROM st WHERE step = 64),
       directed AS (SELECT k.id, k.neighbor, exp(-greatest(dist - rho, 0.0) / scale) AS m
                    FROM knn k JOIN scales s ON k.id = s.id),
       both_ AS (SELECT least(id, neighbor) AS a, greatest(id, neighbor) AS b,
                        coalesce(max(m) FILTER (WHERE id < neighbor), 0.0) AS p,
                        coalesce(max(m) FILTER (WHERE id > neighbor), 0.0) AS q
                 FROM directed GROUP BY 1, 2)
       SELECT a, b, round(p + q - p * q, 5) AS w FROM both_ WHERE p + q - p * q > 0"""
)
def fuzzy_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Symmetric membership strengths among nearest vectors."""
    knn = cut(neighbors.knn_cosine(embedding_vectors(spark, folder)))
    return layout.fuzzy_graph(knn).select("a", "b", F.round("w", 5).alias("w"))


def _rounded(points: DataFrame) -> DataFrame:
    return points.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def map_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Hellinger map of whole documents."""
    return _rounded(layout.map_bags(cut(document_wbag(spark, folder))))


@query()
def map_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine map of vectors."""
    return _rounded(layout.map_vectors(embedding_vectors(spark, folder)))


def vector_map(spark: SparkSession, folder: str) -> DataFrame:
    """The library's own map of all vectors in all their dimensions."""
    return cut(layout.map_vectors(embedding_vectors(spark, folder)))


@query()
def map_warm(spark: SparkSession, folder: str) -> DataFrame:
    """A cosine map started at another map."""
    vectors = layout.searched(embedding_vectors(spark, folder))
    start = cut(layout.map_vectors(vectors))
    return _rounded(layout.map_vectors(vectors, start=start))


@query()
def density_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Most stable density clusters of map points."""
    return cluster.density_clusters(vector_map(spark, folder))


@query()
def leaf_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Finest density clusters of map points."""
    return cluster.density_clusters(vector_map(spark, folder), select="leaf")


def _closed_bins_sql() -> str:
    return f"""WITH {inputs.HOST_INSTANCES_SQL}
        SELECT epoch_us(bin) AS bin_us, hostname, cmdline, count(*) AS n
        FROM instances
        WHERE bin + INTERVAL 3 HOUR
              <= (SELECT date_trunc('millisecond', max("timestamp")) FROM instances) - INTERVAL 3 HOUR
        GROUP BY 1, 2, 3"""


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder.rstrip('/')}/events.parquet").schema
    raw = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Drive a stream over what is there now and read the table it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    run = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", path + "-progress")
        .trigger(availableNow=True)
        .start(path)
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(
    f"""WITH {inputs.PROCESS_FILTERED_SQL}
        SELECT pid_hash, hostname, name, cmdline, ptree, epoch_us("timestamp") AS ts_us
        FROM process_filtered"""
)
def stream_curation(spark: SparkSession, folder: str) -> DataFrame:
    """The curation query on a stream of processes."""
    events = _event_stream(spark, folder)
    kept = streaming.stream_curate(
        inputs.as_process(events),
        inputs.process_path(spark, folder),
        inputs.TEST_MARKS,
        inputs.TEST_START,
    )
    return _run_to_end(kept, "curated").select(
        "pid_hash", "hostname", "name", "cmdline", "ptree", F.unix_micros("timestamp").alias("ts_us")
    )


@query(_closed_bins_sql())
def stream_host_times(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming host-time counts; bins still open at the end are not out yet."""
    processes = curate.select_process(inputs.as_process(_event_stream(spark, folder)))
    counts = _run_to_end(
        streaming.stream_host_time_counts(processes, origin=inputs.TEST_ORIGIN), "host_times"
    )
    uniq = bags.uniques(inputs.all_processes(spark, folder), "cmdline", "pid_hash")
    return bags.deunique(counts, uniq.select("obj_id", "obj")).select(
        F.unix_micros("bin").alias("bin_us"), "hostname", F.col("obj").alias("cmdline"), "n"
    )


#: arrival of an event: most come in order of time, every eleventh in the last of the batches
ARRIVALS = 4


def _late_rows_sql() -> str:
    return f"""WITH {inputs.HOST_INSTANCES_SQL},
        span AS (SELECT min("timestamp") AS a, max("timestamp") AS b FROM instances),
        came AS (
          SELECT bin, hostname, cmdline, "timestamp" AS t,
                 CASE WHEN CAST(pid_hash AS BIGINT) % 11 = 0 THEN {ARRIVALS - 1}
                      ELSE least({ARRIVALS - 1}, {ARRIVALS} * (epoch_us("timestamp") - epoch_us(a)) // (epoch_us(b) - epoch_us(a) + 1)) END AS batch
          FROM instances, span),
        seen AS (SELECT batch, date_trunc('millisecond', max(t)) AS top FROM came GROUP BY 1),
        mark AS (SELECT s.batch, (SELECT max(e.top) FROM seen e WHERE e.batch < s.batch - 1) - INTERVAL 3 HOUR AS w FROM seen s)
        SELECT epoch_us(bin) AS bin_us, hostname, cmdline, count(*) AS n
        FROM came JOIN mark USING (batch)
        WHERE (w IS NULL OR bin + INTERVAL 3 HOUR > w)
          AND bin + INTERVAL 3 HOUR <= (SELECT max(top) FROM seen) - INTERVAL 3 HOUR
        GROUP BY 1, 2, 3"""


@query(_late_rows_sql())
def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows behind the watermark that the batch before ran with are left out.

    That watermark comes from the batches before it, since Spark raises it between batches.
    """
    instances = cut(inputs.host_instances(spark, folder).select("pid_hash", "hostname", "cmdline", "timestamp"))
    micros = F.unix_micros("timestamp")
    span = instances.agg(F.min(micros).alias("a"), F.max(micros).alias("b")).first()
    in_order = F.expr(f"{ARRIVALS} * (unix_micros(timestamp) - {span.a or 0}) div {(span.b or 0) - (span.a or 0) + 1}")
    batch = F.when(F.col("pid_hash").cast("long") % 11 == 0, ARRIVALS - 1).otherwise(F.least(F.lit(ARRIVALS - 1), in_order))
    path = scratch_path(spark, "arrivals")
    for nth in range(ARRIVALS):  # one file for each micro-batch, in order of arrival
        instances.filter(batch == nth).coalesce(1).write.mode("append").parquet(path)
    arriving = spark.readStream.schema(instances.schema).option("maxFilesPerTrigger", 1).parquet(path)
    counts = _run_to_end(streaming.stream_host_time_counts(arriving, origin=inputs.TEST_ORIGIN), "late_rows")
    names = instances.select(bags.object_id(F.col("cmdline")).alias("obj_id"), "cmdline").distinct()
    return counts.join(names, "obj_id").select(F.unix_micros("bin").alias("bin_us"), "hostname", "cmdline", "n")


@query(
    f"""WITH {inputs.HOST_INSTANCES_SQL},
        bag AS (SELECT row_id, cmdline AS col_id, count(*) AS n FROM instances GROUP BY 1, 2),
        {inputs.WEIGHTS_SQL}
        SELECT pid_hash AS row_id, cmdline AS col_id, round(bits, 6) + 0.0 AS w
        FROM processes JOIN weights ON cmdline = col_id"""
)
def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Newly arriving processes scored with stored weights."""
    bag = bags.bag_of_pairs(inputs.host_instances(spark, folder), "row_id", "cmdline")
    stored = cut(weights.information_weights(bag))
    arriving = curate.select_process(inputs.as_process(_event_stream(spark, folder))).select(
        F.col("pid_hash").alias("row_id"), F.col("cmdline").alias("col_id"), F.lit(1).alias("n")
    )
    scored = _run_to_end(streaming.stream_scores(arriving, stored), "scores")
    return scored.select("row_id", "col_id", (F.round("w", 6) + 0.0).alias("w"))

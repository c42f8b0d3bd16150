"""Queries over clusters, labels, map tables and alignment, with given clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemap.functions.text import hover_text
from telemap.operators import bags, labels, maps, weights
from telemap.plans import Registry, inputs
from telemap.session import cut
from telemap.sources import read_source

REGISTRY = Registry()
query = REGISTRY.query


def document_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Documents clustered by source number; sources 0 to 2 count as noise."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return read_source(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(number < 3, F.lit(-1)).otherwise(number - 3).cast("int").alias("cluster"),
    )


DOCUMENT_CLUSTERS_SQL = r"""
    clusters AS (
      SELECT doc_id AS id,
             CASE WHEN CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) < 3 THEN -1
                  ELSE CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) - 3 END AS cluster
      FROM documents)"""

_DOC_WBAG_SQL = f"{inputs.DOCUMENT_BAG_SQL}, {inputs.WEIGHTS_SQL}, {DOCUMENT_CLUSTERS_SQL}"

_GAPS_SQL = """
    base AS (SELECT col_id, sum(w) / (SELECT sum(w) FROM wbag) AS base FROM wbag GROUP BY 1),
    cbits AS (SELECT cluster, col_id, sum(w) AS bits FROM wbag JOIN clusters ON row_id = id
              WHERE cluster >= 0 GROUP BY 1, 2),
    loc AS (SELECT cluster, col_id, bits / sum(bits) OVER (PARTITION BY cluster) AS local FROM cbits),
    grid AS (
      SELECT c.cluster, b.col_id, coalesce(l.local, 0.0) AS local, b.base
      FROM (SELECT DISTINCT cluster FROM cbits) c CROSS JOIN base b
      LEFT JOIN loc l ON l.cluster = c.cluster AND l.col_id = b.col_id),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY cluster
                                   ORDER BY round(abs(local - base), 9) DESC, col_id) AS rank
      FROM grid),
    top AS (SELECT * FROM ranked WHERE rank <= 3)"""


def document_wbag(spark: SparkSession, folder: str) -> DataFrame:
    return weights.information_bag(inputs.document_bag(spark, folder))


def item_wbag(spark: SparkSession, folder: str) -> DataFrame:
    bag = inputs.item_bag(spark, folder)
    return weights.reweight(bag, weights.information_weights(bag))


@query(f"WITH {DOCUMENT_CLUSTERS_SQL} SELECT count(DISTINCT cluster) AS n_clusters FROM clusters WHERE cluster >= 0")
def num_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """A5: clusters, noise not counted."""
    return labels.num_clusters(document_clusters(spark, folder))


@query(
    f"""WITH {DOCUMENT_CLUSTERS_SQL}
        SELECT id, cluster FROM clusters WHERE cluster = 4"""
)
def of_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one cluster."""
    return labels.of_cluster(document_clusters(spark, folder), 4)


@query(
    f"""WITH {_DOC_WBAG_SQL},
        cbits AS (SELECT cluster, col_id, sum(w) AS bits FROM wbag JOIN clusters ON row_id = id
                  GROUP BY 1, 2)
        SELECT cluster, col_id, round(bits, 5) + 0.0 AS bits FROM cbits"""
)
def cluster_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Column totals per cluster."""
    totals = labels.cluster_bits(document_wbag(spark, folder), document_clusters(spark, folder))
    return totals.select("cluster", "col_id", (F.round("bits", 5) + 0.0).alias("bits"))


@query(
    f"""WITH {_DOC_WBAG_SQL},
        cbits AS (SELECT cluster, col_id, sum(w) AS bits FROM wbag JOIN clusters ON row_id = id
                  GROUP BY 1, 2)
        SELECT cluster, col_id, round(bits / sum(bits) OVER (PARTITION BY cluster), 7) + 0.0 AS share
        FROM cbits"""
)
def col_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Column shares per cluster."""
    totals = labels.cluster_bits(document_wbag(spark, folder), document_clusters(spark, folder))
    return labels.col_distribution(totals, "cluster").select(
        "cluster", "col_id", (F.round("share", 7) + 0.0).alias("share")
    )


@query(
    f"""WITH {_DOC_WBAG_SQL},
        totals AS (SELECT col_id, sum(w) AS w FROM wbag GROUP BY 1)
        SELECT col_id, round(w / sum(w) OVER (), 9) + 0.0 AS share FROM totals"""
)
def col_distribution_all(spark: SparkSession, folder: str) -> DataFrame:
    """A14 over all rows: the null distribution."""
    totals = document_wbag(spark, folder).groupBy("col_id").agg(F.sum("w").alias("bits"))
    return labels.col_distribution(totals).select(
        "col_id", (F.round("share", 9) + 0.0).alias("share")
    )


@query(
    f"""WITH {_DOC_WBAG_SQL}, {_GAPS_SQL}
        SELECT cluster, col_id, round(local, 7) + 0.0 AS local, round(base, 7) + 0.0 AS base,
               CAST(rank AS INTEGER) AS rank FROM top"""
)
def top_items(spark: SparkSession, folder: str) -> DataFrame:
    """The three columns per cluster with the largest gap."""
    gaps = labels.share_gaps(document_wbag(spark, folder), document_clusters(spark, folder))
    return labels.top_items(gaps).select(
        "cluster",
        "col_id",
        (F.round("local", 7) + 0.0).alias("local"),
        (F.round("base", 7) + 0.0).alias("base"),
        "rank",
    )


@query(
    f"""WITH {_DOC_WBAG_SQL}, {_GAPS_SQL},
        topics AS (
          SELECT cluster,
                 string_agg(CASE WHEN local > base THEN '>' ELSE '<' END
                            || list_extract(string_split(col_id, '\\'), -1), chr(10) ORDER BY rank)
                 || repeat(chr(8237), cluster) AS label
          FROM top GROUP BY cluster)
        SELECT DISTINCT c.cluster, coalesce(t.label, 'Unlabelled') AS label
        FROM clusters c LEFT JOIN topics t USING (cluster)""".replace("\\\\", "\\")
)
def cluster_topics(spark: SparkSession, folder: str) -> DataFrame:
    """What sets each cluster apart."""
    return labels.cluster_topics(
        document_wbag(spark, folder), document_clusters(spark, folder)
    )


@query(
    f"""WITH {inputs.ITEM_BAG_SQL}, {inputs.WEIGHTS_SQL},
        clusters AS (SELECT o_orderkey AS id,
                            CASE o_orderstatus WHEN 'P' THEN -1 WHEN 'F' THEN 0 ELSE 1 END AS cluster
                     FROM orders), {_GAPS_SQL}
        SELECT cluster, col_id, CAST(rank AS INTEGER) AS rank, local > base AS more FROM top"""
)
def item_topics(spark: SparkSession, folder: str) -> DataFrame:
    """V18 on items, one large cluster per order status."""
    clusters = read_source(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", -1)
        .when(F.col("o_orderstatus") == "F", 0)
        .otherwise(1)
        .alias("cluster"),
    )
    gaps = labels.share_gaps(item_wbag(spark, folder), clusters)
    return labels.top_items(gaps).select(
        "cluster", "col_id", "rank", (F.col("local") > F.col("base")).alias("more")
    )


def host_clusters(instances: DataFrame) -> DataFrame:
    """Host-times clustered by weekday; Sundays count as noise."""
    day = F.dayofweek("bin") - 1
    return instances.select(
        F.col("row_id").alias("id"), F.when(day == 0, -1).otherwise(day - 1).cast("int").alias("cluster")
    ).distinct()


_HOST_SQL = f"""{inputs.HOST_INSTANCES_SQL},
    bag AS (SELECT row_id, cmdline AS col_id, count(*) AS n FROM instances GROUP BY 1, 2),
    {inputs.WEIGHTS_SQL},
    clusters AS (SELECT DISTINCT row_id AS id, CASE WHEN dayofweek(bin) = 0 THEN -1
                 ELSE dayofweek(bin) - 1 END AS cluster FROM instances),
    cbits AS (SELECT cluster, col_id, sum(w) AS bits FROM wbag JOIN clusters ON row_id = id
              WHERE cluster >= 0 GROUP BY 1, 2),
    members AS (
      SELECT cluster, cmdline, i.name, "timestamp", pid_hash
      FROM instances i JOIN clusters ON row_id = id WHERE cluster >= 0),
    scored AS (
      SELECT m.*, bits FROM members m JOIN cbits b
        ON b.cluster = m.cluster AND b.col_id = m.cmdline),
    firsts AS (
      SELECT cluster, cmdline, arg_min(name, ("timestamp", pid_hash)) AS name
      FROM scored WHERE bits >= 1e-6 GROUP BY 1, 2),
    names AS (SELECT cluster, name, avg(bits) AS bits FROM scored GROUP BY 1, 2),
    kept AS (
      SELECT n.cluster, n.name, n.bits FROM names n
      WHERE bits >= 1.0 AND EXISTS (
        SELECT 1 FROM firsts f WHERE f.cluster = n.cluster AND f.name = n.name)),
    near AS (SELECT *, max(bits) OVER (PARTITION BY cluster) AS best FROM kept),
    ranked AS (
      SELECT cluster, name, bits,
             row_number() OVER (PARTITION BY cluster ORDER BY round(bits, 9) DESC, name) AS rank
      FROM near WHERE bits >= best / 10.0)"""


def _host_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    instances = cut(inputs.host_instances(spark, folder))
    bag = cut(bags.bag_of_pairs(instances, "row_id", "obj_id"))
    wbag = weights.reweight(bag, weights.information_weights(bag))
    return wbag, host_clusters(instances), instances


@query(f"WITH {_HOST_SQL} SELECT cluster, cmdline, count(*) AS n FROM members GROUP BY 1, 2")
def cluster_members(spark: SparkSession, folder: str) -> DataFrame:
    """Process instances of each cluster."""
    _, clusters, instances = _host_inputs(spark, folder)
    members = labels.cluster_members(instances, clusters.filter("cluster >= 0"))
    return members.groupBy("cluster", "cmdline").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_HOST_SQL}
        SELECT pid_hash, cluster, round(bits, 5) + 0.0 AS bits FROM scored"""
)
def attach_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Members with the bits of their command line in the cluster."""
    wbag, clusters, instances = _host_inputs(spark, folder)
    real = clusters.filter("cluster >= 0")
    members = labels.cluster_members(instances, real)
    scored = labels.attach_bits(members, labels.cluster_bits(wbag, real))
    return scored.select("pid_hash", "cluster", (F.round("bits", 5) + 0.0).alias("bits"))


@query(f"WITH {_HOST_SQL} SELECT cluster, cmdline, name FROM firsts")
def first_names(spark: SparkSession, folder: str) -> DataFrame:
    """Name of the first instance of each object in a cluster."""
    wbag, clusters, instances = _host_inputs(spark, folder)
    real = clusters.filter("cluster >= 0")
    names = labels.attach_bits(
        labels.object_names(labels.cluster_members(instances, real)), labels.cluster_bits(wbag, real)
    ).filter(F.col("bits") >= labels.OBJECT_BITS)
    uniq = bags.uniques(instances, "cmdline", "pid_hash").select("obj_id", "obj")
    return bags.deunique(labels.first_name(names), uniq).select(
        "cluster", F.col("obj").alias("cmdline"), "name"
    )


@query(
    f"""WITH {_HOST_SQL} SELECT cluster, name, round(bits, 5) + 0.0 AS bits FROM names"""
)
def name_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Mean bits per name and cluster, over instances."""
    wbag, clusters, instances = _host_inputs(spark, folder)
    real = clusters.filter("cluster >= 0")
    names = labels.attach_bits(
        labels.object_names(labels.cluster_members(instances, real)), labels.cluster_bits(wbag, real)
    )
    return labels.name_bits(names).select(
        "cluster", "name", (F.round("bits", 5) + 0.0).alias("bits")
    )


@query(
    f"""WITH {_HOST_SQL}
        SELECT cluster, name, round(bits, 5) + 0.0 AS bits, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE rank <= 3"""
)
def workload_names(spark: SparkSession, folder: str) -> DataFrame:
    """Dominant names per cluster."""
    return labels.workload_names(*_host_inputs(spark, folder)).select(
        "cluster", "name", (F.round("bits", 5) + 0.0).alias("bits"), "rank"
    )


@query(
    f"""WITH {_HOST_SQL},
        lines AS (SELECT cluster, string_agg(printf('%s %.1f', name, bits), chr(10) ORDER BY rank) AS label
                  FROM ranked WHERE rank <= 3 GROUP BY 1)
        SELECT DISTINCT c.cluster, coalesce(l.label, 'Unlabelled') AS label
        FROM clusters c LEFT JOIN lines l USING (cluster)"""
)
def workload_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One label per cluster of host-times."""
    return labels.workload_labels(*_host_inputs(spark, folder))


@query(
    f"""WITH {_HOST_SQL}
        SELECT cluster, col_id, CAST(row_number() OVER (PARTITION BY cluster
               ORDER BY round(bits, 9) DESC, col_id) AS INTEGER) AS rank FROM cbits"""
)
def rank_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of a cluster by descending bits."""
    instances = inputs.host_instances(spark, folder)
    bag = bags.bag_of_pairs(instances, "row_id", "cmdline")
    wbag = weights.reweight(bag, weights.information_weights(bag))
    real = host_clusters(instances).filter("cluster >= 0")
    return labels.rank_columns(labels.cluster_bits(wbag, real)).select("cluster", "col_id", "rank")


def plane(spark: SparkSession, folder: str, dims: tuple[int, int] = (0, 1)) -> DataFrame:
    """Two coordinates of the given vectors as a map, labelled by their given class.

    Vectors of class 9 stand for unplaced points.
    """
    placed = F.col("label") < 9
    return read_source(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(placed, F.col("embedding")[dims[0]].cast("double")).alias("x"),
        F.when(placed, F.col("embedding")[dims[1]].cast("double")).alias("y"),
        F.col("label").cast("string").alias("label"),
        F.col("label").alias("cluster"),
    )


def _plane_sql(name: str, i: int, j: int) -> str:
    return f"""{name} AS (
      SELECT vec_id AS id, CASE WHEN label < 9 THEN CAST(embedding[{i}] AS DOUBLE) END AS x,
             CASE WHEN label < 9 THEN CAST(embedding[{j}] AS DOUBLE) END AS y,
             CAST(label AS VARCHAR) AS label, label AS cluster FROM embeddings)"""


PLANE_SQL = _plane_sql("plane", 1, 2)


@query(f"WITH {PLANE_SQL} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM plane WHERE x IS NOT NULL AND y IS NOT NULL")
def valid_points(spark: SparkSession, folder: str) -> DataFrame:
    """Validly placed points."""
    return maps.valid_points(plane(spark, folder)).select(
        "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    )


@query(
    f"""WITH {PLANE_SQL}
        SELECT bool_or(x IS NULL AND y IS NULL) AS any_unplaced, count(x) AS n_placed,
               count(*) AS n_points FROM plane"""
)
def placement(spark: SparkSession, folder: str) -> DataFrame:
    """Unplaced points."""
    return maps.placement(plane(spark, folder))


@query(
    """SELECT doc_id, source FROM documents WHERE contains(lower(text), lower('Ention'))"""
)
def search_points(spark: SparkSession, folder: str) -> DataFrame:
    """Text search over annotations."""
    docs = read_source(spark, folder, "documents")
    return maps.search_points(docs, "Ention", "text").select("doc_id", "source")


@query(
    f"""WITH {PLANE_SQL}, names AS (SELECT n_nationkey AS cluster, n_name AS label FROM nation
                                    WHERE n_nationkey < 7)
        SELECT id, coalesce(n.label, 'Unlabelled') AS label
        FROM plane p LEFT JOIN names n USING (cluster)"""
)
def label_points(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster labels on points, with a default."""
    names = read_source(spark, folder, "nation").filter("n_nationkey < 7").select(
        F.col("n_nationkey").alias("cluster"), F.col("n_name").alias("label")
    )
    points = plane(spark, folder).drop("label")
    return maps.label_points(points, names).select("id", "label")


_TOP_PROPS_SQL = """
    top AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1
            ORDER BY n DESC, label LIMIT 3),
    dictionary AS (
      SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS rank FROM top
      UNION ALL SELECT 'Unlabelled', count(*) FROM top)"""


@query(
    f"""WITH {_TOP_PROPS_SQL}
        SELECT event_id AS id, coalesce(t.label, 'Unlabelled') AS label, CAST(rank AS BIGINT) AS rank
        FROM events e LEFT JOIN top t ON e.event_type = t.label
        JOIN dictionary d ON d.label = coalesce(t.label, 'Unlabelled')"""
)
def rank_points(spark: SparkSession, folder: str) -> DataFrame:
    """Colour rank of every point's label."""
    events = read_source(spark, folder, "events").select("event_id", "event_type")
    top = bags.top_values(events, "event_type", 3)
    points = bags.bucket_labels(events, "event_type", top).select(
        F.col("event_id").alias("id"), "label"
    )
    return maps.rank_points(points, maps.label_dictionary(top, "event_type")).select(
        "id", "label", "rank"
    )


_PLANE_B_SQL = _plane_sql("plane_b", 3, 4)


@query(
    f"""WITH {PLANE_SQL}, {_PLANE_B_SQL}
        SELECT a.id, round(a.x, 6) AS x1, round(a.y, 6) AS y1, round(b.x, 6) AS x2, round(b.y, 6) AS y2
        FROM plane a JOIN plane_b b USING (id)
        WHERE a.x IS NOT NULL AND a.y IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL"""
)
def common_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points placed in both maps."""
    both = maps.common_points(plane(spark, folder), plane(spark, folder, (2, 3)))
    return both.select("id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


_MOMENTS_SQL = f"""{PLANE_SQL}, {_PLANE_B_SQL},
    common AS (
      SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
      FROM plane a JOIN plane_b b USING (id)
      WHERE a.x IS NOT NULL AND a.y IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL),
    m AS (
      SELECT count(*) AS n, avg(x1) AS mean_x1, avg(y1) AS mean_y1, avg(x2) AS mean_x2,
             avg(y2) AS mean_y2, count(*) * (var_pop(x1) + var_pop(y1)) AS norm2_a,
             count(*) * (var_pop(x2) + var_pop(y2)) AS norm2_b,
             count(*) * covar_pop(x1, x2) AS cross_xx, count(*) * covar_pop(x1, y2) AS cross_xy,
             count(*) * covar_pop(y1, x2) AS cross_yx, count(*) * covar_pop(y1, y2) AS cross_yy
      FROM common)"""
_MOMENTS = (
    "mean_x1",
    "mean_y1",
    "mean_x2",
    "mean_y2",
    "norm2_a",
    "norm2_b",
    "cross_xx",
    "cross_xy",
    "cross_yx",
    "cross_yy",
)


@query(
    f"WITH {_MOMENTS_SQL} SELECT n, "
    + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _MOMENTS)
    + " FROM m"
)
def procrustes_moments(spark: SparkSession, folder: str) -> DataFrame:
    """The moments an alignment needs."""
    both = maps.common_points(plane(spark, folder), plane(spark, folder, (2, 3)))
    return maps.procrustes_moments(both).select(
        "n", *[(F.round(c, 6) + 0.0).alias(c) for c in _MOMENTS]
    )


# In the plane the best rotation or reflection has a closed form: compare the
# best rotation's score with the best reflection's.
_ALIGN_SQL = f"""{_MOMENTS_SQL},
    t AS (
      SELECT *, sqrt(pow(cross_xx + cross_yy, 2) + pow(cross_xy - cross_yx, 2)) AS turn,
             sqrt(pow(cross_xx - cross_yy, 2) + pow(cross_xy + cross_yx, 2)) AS flip,
             sqrt(norm2_a / norm2_b) AS s FROM m),
    r AS (
      SELECT *,
        CASE WHEN turn >= flip THEN (cross_xx + cross_yy) / turn ELSE (cross_xx - cross_yy) / flip END AS r11,
        CASE WHEN turn >= flip THEN (cross_xy - cross_yx) / turn ELSE (cross_xy + cross_yx) / flip END AS r12,
        CASE WHEN turn >= flip THEN (cross_yx - cross_xy) / turn ELSE (cross_xy + cross_yx) / flip END AS r21,
        CASE WHEN turn >= flip THEN (cross_xx + cross_yy) / turn ELSE (cross_yy - cross_xx) / flip END AS r22
      FROM t),
    aligned AS (
      SELECT id, x1 - mean_x1 AS x1, y1 - mean_y1 AS y1,
             s * (r11 * (x2 - mean_x2) + r12 * (y2 - mean_y2)) AS x2,
             s * (r21 * (x2 - mean_x2) + r22 * (y2 - mean_y2)) AS y2
      FROM common, r)"""


@query(
    f"""WITH {_ALIGN_SQL}
        SELECT id, round(x1, 5) + 0.0 AS x1, round(y1, 5) + 0.0 AS y1, round(x2, 5) + 0.0 AS x2,
               round(y2, 5) + 0.0 AS y2 FROM aligned"""
)
def procrustes(spark: SparkSession, folder: str) -> DataFrame:
    """One map turned and scaled onto another."""
    aligned = maps.procrustes(plane(spark, folder), plane(spark, folder, (2, 3)))
    return aligned.select("id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    f"""WITH {_ALIGN_SQL}
        SELECT a.id, round(x1, 5) + 0.0 AS x1, round(y1, 5) + 0.0 AS y1, round(x2, 5) + 0.0 AS x2,
               round(y2, 5) + 0.0 AS y2, CAST(label AS VARCHAR) AS label, 'vector ' || a.id AS hover_text
        FROM aligned a JOIN embeddings ON vec_id = a.id"""
)
def compare_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Two aligned maps side by side."""
    points = plane(spark, folder)
    meta = points.select(
        "id", "label", F.concat(F.lit("vector "), F.col("id").cast("string")).alias("hover_text")
    )
    both = maps.compare_maps(points, plane(spark, folder, (2, 3)), meta)
    return both.select(
        "id",
        *[(F.round(c, 5) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")],
        "label",
        "hover_text",
    )


@query(
    f"""WITH {PLANE_SQL}
        SELECT label, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, count(*) AS n
        FROM plane WHERE x IS NOT NULL GROUP BY 1"""
)
def label_centres(spark: SparkSession, folder: str) -> DataFrame:
    """Label anchors at the mean."""
    centres = labels.label_centres(maps.valid_points(plane(spark, folder)))
    return centres.select(
        "label", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"), "n"
    )


@query(
    f"""WITH {PLANE_SQL}, p AS (SELECT * FROM plane WHERE x IS NOT NULL),
        sums AS (
          SELECT a.label, a.id, sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS s
          FROM p a JOIN p b USING (label) GROUP BY 1, 2)
        SELECT label, arg_min(id, (round(s, 9), id)) AS id FROM sums GROUP BY 1"""
)
def label_medoids(spark: SparkSession, folder: str) -> DataFrame:
    """Label anchors at the medoid; the SQL forms all pairs, the operator none."""
    return labels.label_medoids(maps.valid_points(plane(spark, folder))).select("label", "id")


@query(
    f"""WITH {PLANE_SQL}, p AS (SELECT * FROM plane WHERE x IS NOT NULL),
        c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1)
        SELECT label, round(avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 6) AS spread
        FROM p JOIN c USING (label) GROUP BY 1"""
)
def label_spread(spark: SparkSession, folder: str) -> DataFrame:
    """How far a label's points lie from its anchor."""
    return labels.label_spread(maps.valid_points(plane(spark, folder))).select(
        "label", F.round("spread", 6).alias("spread")
    )


@query(
    f"""WITH {PLANE_SQL}, counts AS (SELECT label, count(*) AS n FROM plane GROUP BY 1),
        span AS (SELECT min(id) AS lo, max(id) AS hi FROM plane)
        SELECT id, round(x, 6) AS x, round(y, 6) AS y, label,
               '(' || n || 'x) class ' || label AS hover_text,
               round((id - lo) / CAST(hi - lo AS DOUBLE), 6) AS colour
        FROM plane JOIN counts USING (label), span WHERE x IS NOT NULL"""
)
def map_table(spark: SparkSession, folder: str) -> DataFrame:
    """Everything a viewer needs for one map."""
    points = plane(spark, folder)
    counts = bags.value_counts(points, "label")
    hover = points.join(counts, "label").select(
        "id", hover_text(F.col("n"), F.concat(F.lit("class "), F.col("label"))).alias("hover_text")
    )
    low = points.agg(F.min("id").alias("v")).scalar()
    high = points.agg(F.max("id").alias("v")).scalar()
    colour = points.select("id", ((F.col("id") - low) / (high - low)).alias("colour"))
    table = maps.map_table(points.select("id", "x", "y"), points.select("id", "label"), hover, colour)
    return table.select(
        "id",
        F.round("x", 6).alias("x"),
        F.round("y", 6).alias("y"),
        "label",
        "hover_text",
        F.round("colour", 6).alias("colour"),
    )

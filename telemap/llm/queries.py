"""One registered query for each operator of this subpackage, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemap.plans import Registry

REGISTRY = Registry()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@REGISTRY.query(
    """
-- CRC-32: the usual table of 256 remainders, then one step for each byte
WITH rule AS (SELECT list_transform(range(256), lambda k:
  list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k)) AS t),
placed AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                        lambda x: CAST('0x' || x AS INTEGER)) AS bytes,
         sum(strlen(coalesce(text, '')) + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS until,
         sum(strlen(coalesce(text, '')) + 1) OVER () AS total
  FROM documents),
dealt AS (SELECT *, CAST(least(15, (16 * (2 * until - size)) // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size,
       CAST(xor(list_reduce(bytes, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295)
            AS BIGINT) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM dealt, rule
"""
)
def op7_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards, contiguous by id, of near equal bytes."""
    return shard_table(table(spark, folder, "documents"))


def shard_table(docs: DataFrame) -> DataFrame:
    from telemap.llm.rows import utf8_size
    from telemap.llm.sharding import contiguous_shards

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        (utf8_size("text") + 1).alias("bytes"),
    )
    return contiguous_shards(slim, F.col("bytes")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@REGISTRY.query(
    """
WITH lowered AS (
  SELECT page_id, regexp_extract(url, '://([^/?#]*)([^?#]*)', 1) AS raw,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
parts AS (
  SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path
  FROM lowered),
rules(rhost, rpath, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, rules.verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS nth
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN regexp_matches(p.host || p.path,
         '(^|[./_-])(spam|casino|pills|porn|xxx|viagra|payday|torrent)([./_-]|$)')
         THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND p.host = f.host AND p.path = f.path AND f.nth = 1
"""
)
def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with the rule that decides on its address."""
    from telemap.llm.urls import judge_urls

    return judge_urls(table(spark, folder, "pages"))


@REGISTRY.query()
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its statistics and verdict."""
    from telemap.llm.quality import base_statistics, judge_statistics

    stats = base_statistics(table(spark, folder, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return judge_statistics(stats).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@REGISTRY.query(
    """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM item WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM starts),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM doc, (SELECT DISTINCT k FROM asked) WHERE len(w) >= k),
found AS (
  SELECT doc_id, p, places.k, item_id FROM places JOIN asked ON places.k = asked.k AND array_to_string(w[p:p + places.k - 1], ' ') = win),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM found)) GROUP BY 1),
held AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
         FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(held.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""
)
def op3_contamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against all benchmark items."""
    from telemap.llm.contamination import contamination, is_contaminated

    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


@REGISTRY.query()
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the smallest id of its group of near copies."""
    from telemap.llm.neardup import near_duplicates

    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@REGISTRY.query(
    """
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM doc WHERE len(w) >= 50)),
lead AS (SELECT h, min(doc_id) AS lead FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN lead USING (h) WHERE doc_id > lead),
kept AS (
  SELECT doc_id, count(q) AS n_removed, string_agg(CASE WHEN q IS NULL THEN x END, ' ' ORDER BY i) AS s
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM doc)
  LEFT JOIN (SELECT doc_id AS d, q FROM gone) ON doc_id = d AND i = q GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""
)
def op1_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    from telemap.llm.substrings import remove_repeats

    found = remove_repeats(table(spark, folder, "documents"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@REGISTRY.query()
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its domain posteriors, rate and number of copies."""
    from telemap.llm.mixing import mix

    mixed = mix(table(spark, folder, "documents"), table(spark, folder, "labels"), carry=["doc_id"])
    return mixed.select("row.doc_id", "n_tokens", "posterior", "domain", "rate", "copies")


@REGISTRY.query(
    """
WITH listed AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS t
  FROM conversations GROUP BY 1),
ends AS (SELECT *, list_max(list_transform(range(len(t)), lambda i: CASE WHEN t[i + 1].role = 'assistant' THEN i + 1 ELSE 0 END)) AS last
         FROM listed),
sides AS (
  SELECT conv_id, t[1:last] AS c, last,
         coalesce(list_filter(t[1:last - 1], lambda x: x.role = 'assistant')[-1].text, '') AS earlier
  FROM ends WHERE last > 0),
cut AS (SELECT *, CASE WHEN c[last].text = earlier THEN last ELSE last - 1 END AS n FROM sides),
shown AS (
  SELECT conv_id, CAST(n AS INTEGER) AS prompt_turns,
         list_aggregate(list_transform(c[1:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), 'string_agg', '') AS p,
         CASE WHEN n < last THEN '<|assistant|>' || chr(10) || c[last].text || '<|end|>' || chr(10) ELSE '' END AS chosen,
         CASE WHEN n < last THEN '<|assistant|>' || chr(10) || earlier || '<|end|>' || chr(10) ELSE '' END AS rejected
  FROM cut)
SELECT conv_id, prompt_turns, coalesce(p, '') AS prompt, chosen, rejected,
       CASE WHEN chosen = '' THEN '' ELSE '14-' || length(chosen) END AS chosen_mask,
       CASE WHEN rejected = '' THEN '' ELSE '14-' || length(rejected) END AS rejected_mask
FROM shown
"""
)
def op9_preferences(spark: SparkSession, folder: str) -> DataFrame:
    """A preference pair for every conversation with a reply."""
    from telemap.llm.preferences import conversations_of, format_preferences, stale_pairs

    made = format_preferences(stale_pairs(conversations_of(table(spark, folder, "conversations"))))
    for side in ("chosen_mask", "rejected_mask"):
        made = made.withColumn(side, F.expr(f"array_join(transform({side}, s -> concat(s.start, '-', s.end)), ',')"))
    return made


@REGISTRY.query()
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the license passages in it."""
    from telemap.llm.licenses import scan_licenses

    return scan_licenses(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("licenses.template")), ",").alias("templates"),
        F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("coverage"),
        "licenses",
    )


@REGISTRY.query(
    """
WITH line AS (
  SELECT doc_id, i - 1 AS line, regexp_extract_all(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
own AS (SELECT doc_id, line, list_sort(list_distinct(w)) AS w FROM line WHERE len(w) > 0),
sets AS (SELECT row_number() OVER () AS c, w, len(w) AS n, f FROM (SELECT w, min((doc_id, line)) AS f FROM own GROUP BY 1)),
word AS (SELECT c, n, f, unnest(w) AS x FROM sets),
late AS (SELECT DISTINCT c FROM (
  SELECT a.c FROM word a JOIN word b ON a.x = b.x AND a.c <> b.c AND a.f > b.f
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*)))),
gone AS (SELECT own.doc_id, own.line FROM own JOIN sets USING (w) WHERE (own.doc_id, own.line) > f OR c IN (SELECT c FROM late))
SELECT d.doc_id, (SELECT count(*) FROM own WHERE own.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed,
       coalesce((SELECT string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FROM gone WHERE gone.doc_id = d.doc_id), '') AS removed
FROM documents d
"""
)
def op2_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the lines that repeat an earlier line."""
    from telemap.llm.lines import repeated_lines

    return repeated_lines(table(spark, folder, "documents")).select(
        "doc_id",
        "n_lines",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"),
    )


@REGISTRY.query()
def op12_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the groups in which two tokenizers agree."""
    from telemap.llm.tokens import align_tokenizers

    return align_tokenizers(table(spark, folder, "documents")).drop("ord", "th")


@REGISTRY.query(
    """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.id <> r.id WHERE a.id % 100 = 0),
positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
)
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    from telemap.llm.negatives import mine_negatives

    rows = table(spark, folder, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return mine_negatives(rows, F.expr("vec_id % 100 = 0"))


@REGISTRY.query(
    """
WITH word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
own AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1),
                                                        lambda i: md5(array_to_string(w[i:i + 3], ' '))))) AS s FROM word),
sets AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM own WHERE len(s) > 0 GROUP BY s),
item AS (SELECT c, n, unnest(s) AS x FROM sets),
link AS (
  SELECT a.c AS a, b.c AS b FROM item a JOIN item b ON a.x = b.x AND a.c <> b.c
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
walk AS (
  WITH RECURSIVE step(c, r) AS (
    SELECT c, c FROM sets UNION SELECT s.c, l.b FROM step s JOIN link l ON l.a = s.r)
  SELECT c, min(r) AS component FROM step GROUP BY c)
SELECT o.doc_id, CAST(len(o.s) AS BIGINT) AS n_shingles, coalesce(w.component, o.doc_id) AS component_id
FROM own o LEFT JOIN sets USING (s) LEFT JOIN walk w ON w.c = sets.c
"""
)
def op11_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the smallest id that links of n-gram similarity reach."""
    from telemap.llm.ngrams import ngram_groups

    return ngram_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")

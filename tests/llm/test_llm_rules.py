"""Quality, licenses, addresses, shards, preferences, mixing and the pipeline."""

import hashlib
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from compare import differences
from telemap.llm import licenses as G
from telemap.llm import mixing as M
from telemap.llm import preferences as P
from telemap.llm import quality as Q
from telemap.llm import queries
from telemap.llm import sharding as H
from telemap.llm import urls as U
from telemap.session import cut
from test_llm_dedup import SMALL, frame, odd_documents, prose


@pytest.mark.parametrize("name", ["op6_urls", "op7_shards", "op9_preferences"])
def test_query_equals_sql(spark, name):
    assert differences(spark, SMALL, name) == []


def numpy_estimate(x):
    """Concentration steps on a group, from the same starts, with whole arrays."""
    floor = np.array(Q.FLOOR)
    bins = np.round(x * 8 / floor)
    median = np.array([np.sort(b)[int(np.ceil(len(b) / 2)) - 1] for b in bins.T]) * floor / 8
    z = x - median
    best = None
    for mean, cov in ((np.zeros(Q.P), np.diag(floor**2)), (z.mean(0), np.cov(z.T, bias=True) + np.diag(floor**2))):
        old = 1e9
        for _ in range(1000):
            d2 = np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
            level = np.floor(64 * np.log1p(d2))
            reach = np.sort(level)[int(np.ceil(Q.SUBSET * len(x))) - 1]
            kept = z[level <= reach]
            mean, cov = kept.mean(0), np.cov(kept.T, bias=True) + np.diag(floor**2)
            spread = np.linalg.slogdet(cov)[1] / 2
            if best is None or spread < best[0]:
                best = spread, mean, cov
            if old - spread <= Q.STILL:
                break
            old = spread
    _, mean, cov = best
    d2 = np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
    reach = np.sort(np.floor(64 * np.log1p(d2)))[int(np.ceil(Q.SUBSET * len(x))) - 1]
    return np.sqrt(d2 / max(1.0, np.expm1((reach + 1) / 64) / Q.chi2(Q.P, Q.SUBSET)))


def test_quality_equals_plain_arrays(spark):
    table = queries.op4_quality(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = table.merge(docs, on="doc_id")
    for r in both.itertuples():
        assert brute.statistics(r.text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    fine = both[~both.base_failed].copy()
    many = fine.groupby(["lang", "source"])["doc_id"].transform("size")
    fine["grp"] = np.where(many >= Q.MIN_GROUP, fine.lang + fine.source, "pooled")
    w, c = np.maximum(fine.n_words, 1), np.maximum(fine.word_chars, 1)
    x = np.stack(
        [np.log(w), np.log(c / w), np.minimum(fine.n_symbols / c, 1), np.log1p(fine.n_dup_lines), fine.n_repeat_words / w], 1
    )
    for _, own in fine.reset_index(drop=True).groupby("grp"):
        expected = numpy_estimate(x[own.index])
        assert np.allclose(expected, own.distance, rtol=1e-6)
        assert (own.kept == (expected <= Q.chi2(Q.P, 1 - Q.ALPHA) ** 0.5)).all()
    junk = both.text.map(lambda t: len(re.findall(r"\w(###|\$\$\$|%%%|&&&|\*\*\*)", t)) > 30)
    assert not both.kept[junk].any()
    assert both.kept[~junk & ~both.base_failed].all()


def test_quality_of_odd_documents(spark):
    docs = odd_documents()
    found = Q.judge_quality(frame(spark, docs)).select("row.*", *[F.col(c).alias(f"v_{c}") for c in (*Q.STATS, "kept")])
    rows = found.collect()
    assert sorted(((r["doc_id"], r["v_n_words"]) for r in rows), key=str) == sorted(
        ((i, len(brute.plain(t))) for i, t in docs), key=str
    )
    for r in rows:
        assert tuple(r[f"v_{c}"] for c in Q.STATS) == brute.statistics(r["text"])
        assert r["n_words"] == "n" and r["size"] == 0.5  # the document's own columns stay
    assert Q.judge_quality(frame(spark, docs).limit(0)).count() == 0


def plain_alignment(a, b):
    """Matched words of the best local alignment over the whole table."""
    score = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    same = np.zeros_like(score)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            hit = a[i - 1] == b[j - 1]
            ways = [
                (0, 0),
                (score[i - 1, j - 1] + (G.MATCH if hit else G.MISS), same[i - 1, j - 1] + hit),
                (score[i - 1, j] + G.GAP, same[i - 1, j]),
                (score[i, j - 1] + G.GAP, same[i, j - 1]),
            ]
            score[i, j], same[i, j] = max(ways)
    return same.flat[score.argmax()], score.max()


def test_licenses(spark):
    grant = dict(G.TEMPLATES)["MIT grant"].split()
    changed = [w for k, w in enumerate(grant) if k not in (9, 30)]
    changed[20:20] = ["really", "extra"]
    changed[40] = "other"
    docs = [
        (1, "x y z\nReleased under the MIT License.\nmore text"),
        (2, prose(1, 80) + " ".join(changed) + " " + prose(2, 80)),
        (3, " ".join(grant[:20])),
        (4, None),
        (5, "released UNDER the mit license! Licensed under CC BY-NC 4.0. Released under the MIT License."),
        (6, "This work is licensed under the GNU General Public License, version 3."),
        (5, ""),
    ]
    found = {(r["doc_id"], r["n_words"]): r["licenses"] for r in G.scan_licenses(frame(spark, docs)).collect()}
    names = {k[0]: [m["template"] for m in v] for k, v in found.items() if k[1]}
    assert names[1] == ["MIT notice"] and names[2] == ["MIT grant"] and names[3] == []
    assert names[5] == ["MIT notice", "CC-BY-NC-4.0 notice", "MIT notice"]
    assert "GPL-3.0 notice" in names[6] and "Apache-2.0 notice" not in names[6]
    assert len(found) == len(docs)
    text = brute.letters(docs[1][1])
    template = brute.letters(" ".join(grant))
    matched, _ = plain_alignment(template, text)
    hit = next(v for k, v in found.items() if k[0] == 2)[0]
    assert hit["coverage"] == matched / len(template)
    assert [text[p] for s in hit["spans"] for p in range(s["start"], s["end"])][:3] == template[:3]
    assert G.scan_licenses(frame(spark, docs).limit(0)).count() == 0


def test_every_edited_template_is_found_like_by_full_alignment(spark):
    """Any one word replaced or dropped; as many as the coverage leaves, evenly spread."""
    docs, expected = [], []
    for name, text in G.TEMPLATES:
        own = brute.letters(text)
        lost = len(own) - math.ceil(G.COVERAGE * len(own))
        spread = {round((k + 1) * len(own) / (lost + 1)) - 1 for k in range(lost)}
        forms = [[w if k != p else "other" for k, w in enumerate(own)] for p in range(len(own))]
        forms += [own[:p] + own[p + 1 :] for p in range(len(own))]
        forms += [[w if k not in spread else "other" for k, w in enumerate(own)]]
        for form in forms:
            if plain_alignment(own, form)[0] >= G.COVERAGE * len(own):
                docs.append((len(docs), "some text before " + " ".join(form) + " and after"))
                expected.append(name)
    assert len(docs) > 300
    found = {r["doc_id"]: [m["template"] for m in r["licenses"]] for r in G.scan_licenses(frame(spark, docs)).collect()}
    assert [i for i, name in enumerate(expected) if name not in found[i]] == []


def test_many_copies_of_a_notice_in_one_long_text(spark):
    notice = "Released under the MIT License. "
    seconds = []
    for n in (1000, 4000):
        begin = time.time()
        (row,) = G.scan_licenses(frame(spark, [(1, notice * n)])).collect()
        seconds.append(time.time() - begin)
        starts = [m["spans"][0]["start"] for m in row["licenses"]]
        assert [m["template"] for m in row["licenses"]] == ["MIT notice"] * n and starts == list(range(0, 5 * n, 5))
    assert seconds[1] < 8 * seconds[0] + 5


def test_winnowing_keeps_a_fingerprint_of_every_long_run():
    r = np.random.default_rng(1)
    for _ in range(50):
        grams = r.integers(0, 9, int(r.integers(1, 40))).astype(np.uint64)
        kept = set(G.winnowed(grams).tolist())
        assert all(kept & set(range(k, k + G.WINNOW)) for k in range(len(grams) - G.WINNOW + 1))


def test_odd_addresses(spark):
    urls = [
        (1, None), (2, ""), (3, "www.example.com/en/"), (4, "http://EXAMPLE.com/en/a"), (5, "x://www.example.com/en/?q"),
        (6, "https://a.www.example.com/en/b#c"), (7, "http://notexample.com/en/"), (8, "http://com"), (9, "http://com/"),
        (10, "http://a.net/es/"), (11, "http://a.net/es"), (12, "http://a.net?x=/es/"), (13, "http://spam-farm.org/"),
        (14, "http://spammer.org/pillsbury"), (15, "http://example.com/EN/"), (4, "http://EXAMPLE.com/en/a"), (None, "a://b.net/fr/x"),
    ]
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    found = sorted(map(tuple, U.judge_urls(table).collect()), key=str)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
    expected = []
    for i, u in urls:
        _, sep, rest = (u or "").partition("://")
        rest = re.split("[?#]", rest)[0] if sep else ""
        host, slash, tail = rest.partition("/")
        host, path = host.translate(str.maketrans(U.LOWER[0], U.LOWER[1])), slash + tail
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        bad = re.search("(^|[./_-])(spam|casino|pills|porn|xxx|viagra|payday|torrent)([./_-]|$)", host + path)
        best = max(fits, default=(0, None, "block" if bad else "allow"))
        expected.append((i, host, path, best[1], best[2]))
    assert found == sorted(expected, key=str)
    assert U.judge_urls(table.limit(0)).count() == 0


def test_rules_without_a_literal_are_tried(spark):
    table = spark.createDataFrame([(1, "http://a1234.org/x"), (2, "http://a12.org/"), (3, None)], "page_id long, url string")
    rule = U.Rule("digits", "^[^/]*[0-9]{4}", "block", 5, ())
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge_urls(table, (*U.SITES, rule)).collect()}
    assert found == {1: ("digits", "block"), 2: (None, "allow"), 3: (None, "allow")}


def test_odd_shards(spark):
    docs = odd_documents()
    rows = H.contiguous_shards(frame(spark, docs), shards=4).collect()
    assert len(rows) == len(docs) and rows[0]["row"] is None and rows[0]["ord"] == "x"
    sizes = [len((t or "").encode()) + 1 for _, t in docs]
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    known = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in known] == sorted(r["doc_id"] for r in known)
    equal = [(k, "x" * 99) for k in range(40)]
    totals = H.contiguous_shards(frame(spark, equal), shards=8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert [r["s"] for r in totals] == [500] * 8
    assert H.contiguous_shards(frame(spark, docs).limit(0)).count() == 0


def test_odd_preferences(spark):
    turns = lambda *x: [{"role": r, "text": t} for r, t in x]
    pairs = [
        (1, turns(("user", "q"), ("assistant", "good")), turns(("user", "q"), ("assistant", "bad"))),
        (2, turns(("user", "q")), turns(("user", "q"), ("assistant", "é€"), ("user", "more"), ("assistant", ""))),
        (3, turns(("user", "q")), turns(("user", "q"))),
        (4, None, turns(("assistant", "a"))),
        (5, turns(("user", "same")), turns(("system", "same"))),
        (3, turns(("user", "q")), turns(("user", "q"))),
    ]
    table = spark.createDataFrame(pairs, f"pair long, chosen {P.TURNS}, rejected {P.TURNS}").withColumn("prompt", F.lit("clash"))
    show = lambda t: "".join(f"<|{x['role']}|>\n{x['text']}<|end|>\n" for x in t)
    for (pair, chosen, rejected), r in zip(
        sorted(pairs, key=lambda p: p[0]), sorted(P.format_preferences(table).collect(), key=lambda r: r["pair"])
    ):
        chosen, rejected = chosen or [], rejected or []
        n = next((k for k, (a, b) in enumerate(zip(chosen, rejected)) if a != b), min(len(chosen), len(rejected)))
        assert (r["pair"], r["prompt_turns"], r["prompt"]) == (pair, n, show(chosen[:n]))
        for name, whole in (("chosen", chosen), ("rejected", rejected)):
            assert r[name] == show(whole[n:])
            trained = [r[name][s["start"] : s["end"]] for s in r[f"{name}_mask"]]
            assert trained == [x["text"] + "<|end|>\n" for x in whole[n:] if x["role"] == "assistant"]
    raw = [(1, 1, "assistant", None), (1, 0, None, "q"), (2, 0, "user", "no reply"), (None, 0, "assistant", "x"), (1, 1, "assistant", None)]
    made = P.format_preferences(P.stale_pairs(P.conversations_of(spark.createDataFrame(raw, "conv_id long, turn long, role string, text string"))))
    assert sorted((r["conv_id"] is None, r["prompt_turns"]) for r in made.collect()) == [(False, 3), (True, 0)]
    assert P.format_preferences(table.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    domains, model = M.fit(docs, labels)
    table = cut(M.with_posteriors(docs, ["doc_id"], model))
    steps, wanted, reached = M.fit_rates(table, domains, M.default_factor)
    pdf = table.select("row.doc_id", "n_tokens", "posterior").toPandas()
    p, n = np.stack(pdf.posterior.to_numpy()), pdf.n_tokens.to_numpy(dtype=float)
    assert np.allclose(p.sum(1), 1)
    rate = np.ones(len(p))
    present = n @ p
    for _ in range(len(steps)):  # the same descent on whole arrays
        rate = np.maximum(0, rate - p @ ((n * rate) @ p - wanted).__truediv__(present))
    assert np.allclose(rate, M.rates(p, steps), atol=1e-9)
    assert np.allclose((n * rate) @ p, reached, rtol=1e-9)
    assert np.abs(reached - wanted).sum() < 0.05 * wanted.sum()
    error = lambda r: (((n * r) @ p - wanted) ** 2 / present).sum()
    assert error(rate) < 0.05 * error(np.ones(len(p)))
    mixed = M.mix(docs, labels, carry=["doc_id"])
    first, again = (sorted(mixed.select("row.doc_id", "copies").collect()) for _ in range(2))
    assert first == again


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    even = labels.filter("doc_id % 2 = 0")
    domains, model = M.fit(docs, even)
    toxic = [k for k, d in enumerate(domains) if d[1]]
    found = M.with_posteriors(docs, ["doc_id"], model).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "id"), F.col("row.doc_id") == F.col("id"))
    pdf = found.select("posterior", "toxic").toPandas()
    guess = np.stack(pdf.posterior.to_numpy())[:, toxic].sum(1) > 0.5
    assert (guess == (pdf.toxic == 1)).mean() > 0.95


def test_mixing_of_odd_documents(spark):
    docs = odd_documents()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, None, 0), (None, 1, 0), (14, 0, 0)], "doc_id long, quality int, toxic int")
    plain = M.mix(frame(spark, docs), none)
    assert M.repeated(plain).count() == len(docs)
    mixed = M.mix(frame(spark, docs), some)
    rows = mixed.collect()
    assert len(rows) == len(docs) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in rows)
    assert M.repeated(mixed).count() == sum(r["copies"] for r in rows)
    assert M.repeated(mixed).columns == frame(spark, docs).columns
    assert M.mix(frame(spark, docs).limit(0), some).count() == 0


def test_pipeline_stages(spark):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = cut(stage(spark, docs, SMALL))
        after = docs.collect()
        seen.append((before, after))
        if name != "sharding":
            assert docs.columns == columns
        assert all(before[r["doc_id"]] == r["text"] for r in after)
    (raw, good), (_, apart), (candidates, clean), (pool, mixed), (last, shards) = seen
    verdict = {r["doc_id"]: r["kept"] for r in queries.op4_quality(spark, SMALL).collect()}
    assert sorted(r["doc_id"] for r in good) == sorted(i for i in raw if verdict[i])
    near = brute.near_duplicates([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in apart) == sorted(i for i, _, lead in near if i == lead)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hit = brute.contamination(list(candidates.items()), items)
    assert sorted(r["doc_id"] for r in clean) == sorted(i for i, n, h, _ in hit if not (h > 0 and 20 * h >= n))
    assert {r["doc_id"] for r in mixed} <= set(pool)
    assert sorted(r["shard"] for r in shards) and len(shards) == len(mixed)
    assert hashlib.sha256("".join(sorted(r["text"] for r in shards)).encode()).digest() == hashlib.sha256(
        "".join(sorted(r["text"] for r in mixed)).encode()
    ).digest()


def test_pipeline_of_odd_documents(spark):
    docs = frame(spark, odd_documents())
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = cut(stage(spark, docs, SMALL))
    assert docs.count() > 0
    rows = frame(spark, [(1, "same words here"), (1, "same words here"), (2, None), (2, None), (3, " "), (4, "same words here")])
    kept = corpus_pipeline.near_duplicate(spark, rows, SMALL).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, "same words here"), (2, ""), (2, ""), (3, " ")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), SMALL).count() == 0

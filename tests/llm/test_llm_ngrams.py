"""N-gram join against all pairs: odd tables, families of copies, shared passages."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from compare import differences
from telemap.llm import ngrams as J
from telemap.llm import prefixes as P
from test_llm_dedup import SCHEMA, edited, odd_documents, prose

SMALL = "/root/testdata/sf0.001"


def table(spark, docs):
    rows = [(i, t, "en", "s", "1", 2, "3", "4", 0.5) for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def found(spark, docs):
    rows = J.ngram_groups(table(spark, docs)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def family(seed, copies, words, changes):
    """A text and copies of it and of its copies, many of them near the limit."""
    r = random.Random(seed)
    texts = [prose(seed, words, 30_000)]
    for k in range(copies):
        texts.append(edited(r.choice(texts[:3]), 1000 * seed + k, r.randrange(1, changes)))
    return texts


def crowded():
    """Families at the limit, a passage that all of many texts share, groups of one prefix."""
    docs = [*family(1, 60, 100, 7), *family(2, 40, 150, 9), *family(3, 20, 40, 4)]
    passage = prose(77, 40, 30_000)
    docs += [prose(100 + k, 25, 30_000) + passage for k in range(40)]
    docs += [passage + f" end{k}" for k in range(15)]
    tail = prose(78, 60, 30_000)
    docs += [tail + " " + " ".join(f"{w}" for w in ("x", "y", "z")[: k % 4]) for k in range(12)]
    random.Random(0).shuffle(docs)
    return list(enumerate(docs))


def test_odd_documents_meet_all_pairs(spark):
    docs = odd_documents()
    assert found(spark, docs) == brute.near_duplicates(docs, 4, 85)


@pytest.mark.parametrize("counters", [1 << 20, 1 << 14])
def test_crowded_documents_meet_all_pairs(spark, monkeypatch, counters):
    monkeypatch.setattr(J, "COUNTERS", counters)
    docs = crowded()
    assert found(spark, docs) == brute.near_duplicates(docs, 4, 85)


def test_groups_of_one_prefix_are_expanded(spark, monkeypatch):
    """With one hash for all prefixes of a size, members alone decide."""
    docs = crowded()[:80]
    scan = J.scan
    monkeypatch.setattr(J, "scan", lambda *a: scan(*a).withColumn("start", F.col("start") * 0))
    rows = J.ngram_groups(table(spark, docs)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)
    sets = {i: brute.shingles(t, 4) for i, t in docs}
    sizes = {}
    for i, s in sets.items():
        sizes.setdefault(len(s), []).append(i)
    # links inside a size are all found, and none is made up
    for same in sizes.values():
        for a in same:
            for b in same:
                if a < b and brute.similar(sets[a], sets[b], 85):
                    of = {r[0]: r[2] for r in got}
                    assert of[a] == of[b]


def test_prefix_length_is_enough():
    for n in range(1, 200):
        for m in range(n, 200):
            need = -(-85 * (n + m) // 185)
            if 100 * n >= 85 * m and need <= n:
                assert n - need + 1 <= P.prefix_length(n, 85) and m - need + 1 <= P.prefix_length(m, 85)


def test_query_meets_sql(spark):
    assert differences(spark, SMALL, "op11_ngrams") == []

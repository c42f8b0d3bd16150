"""Alignment of two tokenizers against a walk over both lists."""

import random

import numpy as np
import pytest

import brute
from telemap.llm import tokens as T

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (1, "plain words, and more of them."),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "  two  spaces \n\n and\tlines \r\n"),
    (6, "naïve Größe 漢字 🙂🏽 ‍ x"),
    (7, "a▁b"),
    (8, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (1, "plain words, and more of them."),
    (None, "plain words, and more of them."),
    (9, " " * 70_000 + "x"),
    (10, "ab" * 40_000),
    (11, " \t" * 3_000 + "\x00\x1f\x85 "),
    (12, "x"),
    (-3, "it's they'll I'd 12345 ½²"),
]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def expected(docs):
    return sorted((r[:8] for r in brute.aligned_tokens(docs, T.FOLDER)), key=str)


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, slice int, pairs string")
    assert rows_of(T.align_tokenizers(docs.repartition(3))) == expected(ODD)
    shown = {(r.doc_id, tuple((tuple(g.a), tuple(g.b)) for g in r.groups)) for r in T.token_groups(docs).collect()}
    assert shown == {(r[0], tuple((tuple(a), tuple(b)) for a, b in r[8])) for r in brute.aligned_tokens(ODD, T.FOLDER)}


def test_group_spans(spark):
    text = "some words 漢字 and naïve ends"
    (row,) = T.token_groups(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    whole, pair = (" " + text).encode(), T.read_pair().load()
    at = 0
    for g in row.groups:
        part = whole[g.start : g.end]
        assert g.start == at and part == b"".join(pair.made["a_bytes"][i] for i in g.a) == b"".join(pair.made["b_bytes"][i] for i in g.b)
        at = g.end
    assert at == len(whole)


def test_no_rows(spark):
    assert T.align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_answers_are_rows(spark, monkeypatch):
    """No row of a plan holds all pairs of a slice, and slices of a few documents add up the same."""
    monkeypatch.setattr(T, "SLICE", 50)
    monkeypatch.setattr(T, "PAIR_ROWS", 3)
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(2)
    sliced = T.cut(T._sliced(T.keyed(docs), T.FOLDER))
    assert sliced.filter("size(pairs) > 3 or (doc_id is not null and pairs is not null)").isEmpty()
    aligned = T._aligned(sliced)
    assert "collect_list" not in aligned._jdf.queryExecution().toString()
    assert rows_of(aligned) == expected(ODD)


def test_query_meets_walk(spark):
    import __spark_entry__

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows_of(__spark_entry__.queries()["op12_tokens"](spark, SMALL)) == expected(docs)


def test_both_engines_agree():
    from tokenizers import Tokenizer

    pair = T.read_pair().load()
    slow = Tokenizer.from_str(pair.byte_json)
    slow.encode_special_tokens = True
    r = random.Random(5)
    for _ in range(3000):
        text = " " + "".join(chr(r.choice((r.randrange(32, 127), r.randrange(0xD000), r.randrange(0xE000, 0x110000)))) for _ in range(12))
        assert pair.encode_a(text) == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_pointer_jumping_labels_components(seed):
    r = np.random.default_rng(seed)
    a = np.unique(np.append(r.integers(1, 400, 90), 400))
    b = np.unique(np.append(r.integers(1, 400, 70), 400))
    to_a, to_b = T.terminals(a, b)
    ends = np.intersect1d(a, b)
    assert (b[to_a] == ends[np.searchsorted(ends, a)]).all() and (b[to_b] == ends[np.searchsorted(ends, b)]).all()

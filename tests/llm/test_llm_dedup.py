"""Passages, lines, near copies and contamination: SQL, brute force and odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from compare import differences
from telemap.llm import contamination as C
from telemap.llm import lines as L
from telemap.llm import neardup as N
from telemap.llm import substrings as S
from telemap.llm import words as W

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, ord string, th int, row string, n_words string, size double"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = [f"{'Wört' if k % 7 == 0 else 'word'}{r.randrange(vocabulary)}{'.' if k % 9 == 0 else ''}" for k in range(n)]
    return "".join(w + ("\n" if k % 12 == 11 else " ") for k, w in enumerate(words))


def edited(text, seed, changes):
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def odd_documents():
    """Nulls, empty and long texts, ties, repeated rows, copies of several kinds."""
    base, other = prose(1, 160), prose(2, 130)
    texts = [
        (1, base),
        (2, other),
        (3, base),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b "),
        (7, base.upper()),
        (8, edited(base, 3, 4)),
        (9, edited(base, 4, 12)),
        (9, other),
        (2, other),
        (None, base),
        (None, prose(5, 70)),
        (11, prose(6, 30) + base[: len(base) // 2] + prose(7, 30)),
        (12, "one two"),
        (13, "ONE\ttwo"),
        (14, prose(8, 20_000, 30_000)),
        (15, prose(9, 5) + other),
        (-4, edited(other, 9, 2)),
        (16, "a b c\x1cd"),
        (17, "x " * 120),
    ]
    return texts


def frame(spark, docs):
    rows = [(i, t, "en", None, "x", 1, None, "n", 0.5) for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op1_substrings", "op2_lines", "op3_contamination"])
def test_query_equals_sql(spark, name):
    assert differences(spark, SMALL, name) == []


def test_word_hashes_follow_the_words():
    texts = ["a b\tc", None, "", "Ab  aB\n", "é x", "b" * 3_000_000 + " a", " a"]
    found = W.words(pa.array(texts))
    assert found.counts.tolist() == [3, 0, 0, 2, 1, 2, 1]
    flat = [w for t in texts for w in brute.plain(t)]
    assert len(set(found.hashes.tolist())) == len(set(flat))
    low = W.words(pa.array(["Ab aB"]), W.FOLDED).hashes
    assert low[0] == low[1]
    runs = W.Runs(found.hashes)
    assert runs.of(np.array([0]), 1)[0] == runs.of(np.array([8]), 1)[0]
    parts = list(W.slices(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), "text", 4))
    assert sum(p.num_rows for p in parts) == len(texts)


def test_substrings_of_odd_documents(spark):
    docs = odd_documents()
    found = S.remove_repeats(frame(spark, docs)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=str) == brute.substrings(docs)
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert len(brute.plain(r["kept_text"])) == r["n_words"] - r["n_removed"]
    longest = {r["doc_id"]: r["longest"] for r in found if r["doc_id"] is not None}
    assert longest[3] == 100 and longest[12] is None


def test_lines_of_odd_documents(spark):
    docs = [d for d in odd_documents() if d[0] != 14]
    table = frame(spark, docs)
    found = L.repeated_lines(table)
    assert sorted(((r["doc_id"], r["n_lines"], r["removed_lines"]) for r in found.collect()), key=str) == brute.repeated_lines(docs)
    left = {r["doc_id"]: r["text"] for r in L.without_lines(table, found).filter("doc_id = 3").collect()}
    assert left[3] is not None and "word" not in left[3]


def line_families():
    """Families of lines that share rare words: versions of one line, and lines whose first leader is none of theirs."""
    r, lines = random.Random(11), []
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(20)]
        lines.append(" ".join(base[:6] + [f"own{family}x{k}" for k in range(14)]))
        for _ in range(40):
            version = list(base)
            for k in r.sample(range(20), r.randrange(4)):
                version[k] = f"new{r.randrange(10**6)}"
            lines.append(" ".join(version))
    return lines


@pytest.mark.parametrize("long, leaders, chunk", [(1 << 14, 256, 1 << 20), (8, 2, 64), (8, 2, 3)])
def test_lines_of_families(spark, monkeypatch, long, leaders, chunk):
    """Every copy of an earlier line is found, in short and in long lists, and few pairs are compared in full."""
    asked, copies = [], L._copies

    def counted(pairs, sets):
        asked.append(pairs.count())
        return copies(pairs, sets)

    for name, value in (("LONG", long), ("LEADERS", leaders), ("CHUNK", chunk), ("_copies", counted)):
        monkeypatch.setattr(L, name, value)
    lines = line_families()
    random.Random(5).shuffle(lines)
    docs = [(i, "\n".join(lines[i * 7 : i * 7 + 7])) for i in range(-(-len(lines) // 7))]
    found = L.repeated_lines(frame(spark, docs)).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["removed_lines"]) for r in found), key=str) == brute.repeated_lines(docs)
    sets = [set(x.split()) for x in lines]
    similar = sum(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a != b)
    if long > len(lines):
        assert sum(asked) < similar / 2


def test_rarity_counts_all_words(spark):
    docs = [(1, "a b a"), (2, None), (3, "A\nc"), (4, "")]
    often = L.rarity(frame(spark, docs).withColumn("ord", F.lit(0)))
    hashes = W.words(pa.array(["a b c"]), W.FOLDED).hashes & np.uint64(L.COUNTERS - 1)
    assert often[hashes.astype(np.int64)].tolist() == [3, 1, 1] and often.sum() == 5


@pytest.mark.parametrize("ids", [[9, 5, 3, 8, -2], [None] * 5, [None, 5, 3, None, None]])
def test_lines_read_in_any_order(spark, ids):
    """A line's first place can be read after later ones, here all in one slice."""
    line = "alpha beta gamma delta epsilon zeta eta theta"
    texts = [f"one\ntwo\n{line} iota", f"three\n{line}", line, f"four\nfive\nsix\n{line} kappa", "seven\neight"]
    docs = list(zip(ids, texts))
    rows = [(i, t, "en", None, "x", 1, None, "n", 0.5) for i, t in docs]
    found = L.repeated_lines(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    gone = sorted(((r["doc_id"], r["n_lines"], r["removed_lines"]) for r in found), key=str)
    assert gone == brute.repeated_lines(docs)
    assert sum(len(removed) for *_, removed in gone) == 3


def test_lines_by_slices_of_the_tokens(spark, monkeypatch):
    """The index in slices finds the same lines; copies of rows are fetched once."""
    monkeypatch.setattr(L, "SLICE_SETS", 1)
    docs = [d for d in odd_documents() if d[0] != 14]
    found = L.repeated_lines(frame(spark, docs)).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["removed_lines"]) for r in found), key=str) == brute.repeated_lines(docs)


def test_packed_orders_equal_lexsort():
    rng = np.random.default_rng(3)
    owner = np.sort(rng.integers(0, 90, 3000))
    close = np.uint64(5 << 40) + rng.integers(0, 30, 3000).astype(np.uint64)  # the packed bits do not tell these apart
    for hashes in (rng.integers(0, 1 << 63, 3000).astype(np.uint64), close, close[:0]):
        at = owner[: len(hashes)]
        assert (hashes[L._by_owner(at, hashes)] == hashes[np.lexsort((hashes, at))]).all()
    begin = np.searchsorted(owner, np.arange(91))
    nth, rank = np.arange(3000) - begin[owner], rng.integers(0, 9, 3000)
    assert (L._by_rank(owner, nth, rank, begin) == np.lexsort((nth, rank, owner))).all()
    assert (L._by_rank(owner, nth, rank + (1 << 60), begin) == np.lexsort((nth, rank, owner))).all()


def test_prefix_is_long_enough():
    for n in range(1, 60):
        for m in range(n, 60):
            least = -(-L.PERCENT * (n + m) // (100 + L.PERCENT))
            if least <= n:
                assert L.prefix_length(np.array([n]))[0] >= n - least + 1


def test_near_duplicates_of_odd_documents(spark):
    docs = odd_documents()
    found = N.near_duplicates(frame(spark, docs)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute.near_duplicates(docs)


def test_near_duplicates_of_a_scattered_group(spark):
    """Members at all distances from each other, links across the limit, several components."""
    base = prose(20, 150)
    docs = [(k, edited(base, 100 + k, k % 14)) for k in range(90)]
    chain = base
    for k in range(90, 110):  # each one like its neighbours only
        chain = edited(chain, 300 + k, 3)
        docs.append((k, chain))
    found = N.near_duplicates(frame(spark, docs)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute.near_duplicates(docs)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(5)
    common, one, two = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 100, 100))
    a, b = np.unique(np.concatenate((common, one))), np.unique(np.concatenate((common, two)))
    level = N.registers(np.concatenate((a, b)), np.array([0, len(a)]))
    both = N.registers(np.unique(np.concatenate((a, b))), np.array([0]))
    assert (N.merged(level[0], level[1]) == both[0]).all()
    guess = N.joint_estimate(level[:1], level[1:], np.array([700.0]), np.array([700.0]))[0]
    assert abs(guess - 0.75) < N.MARGIN


def test_contamination_of_odd_documents(spark):
    docs = odd_documents()
    items = [
        (1, " ".join(brute.plain(prose(1, 160))[20:50])),
        (1, " ".join(brute.plain(prose(2, 130))[:13])),
        (2, "one two"),
        (3, None),
        (4, ""),
        (None, "ONE, two!"),
        (10, " ".join(brute.plain(prose(8, 20_000, 30_000))[-14:])),
    ]
    found = C.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=str) == brute.contamination(docs, items)


def test_blocks_of_questions_change_nothing(spark, monkeypatch):
    docs = odd_documents()[:9]
    items = [(k, " ".join(brute.plain(prose(1, 160))[k : k + 20])) for k in range(0, 120, 11)]
    monkeypatch.setattr(C, "BLOCK", 20)
    monkeypatch.setattr(C, "SEGMENT", 200)
    monkeypatch.setattr(C, "CHUNK", 7)
    found = C.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=str) == brute.contamination(docs, items)


def test_proximity(spark):
    docs = [(1, "alpha filler filler beta filler gamma"), (2, "alpha " + "filler " * 40 + "beta gamma"), (3, "gamma beta")]
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in C.contamination(frame(spark, docs), items).collect()}
    assert found == {1: (0, 1), 2: (0, 0), 3: (0, 0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert S.remove_repeats(none).count() == 0
    assert L.repeated_lines(none).count() == 0
    assert N.near_duplicates(none).count() == 0
    assert C.contamination(none, items).count() == 0
    found = C.contamination(frame(spark, odd_documents()[:3]), items).filter(F.col("n_hit") > 0)
    assert found.count() == 0

"""Hand-made cases and random differentials for expressions, bags and labels."""

import contextlib
import math
import random
import shlex

import pytest
from pyspark.sql import functions as F

from telemap.functions import text as fx
from telemap.operators import bags, cooccurrence, curate, hosttime, labels, weights


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


# Hand-made: texts whose quotes do not close, and what they must give.
OPEN_QUOTES = [
    ('run "abc', ["run", '"abc"', "<broken>"]),
    ('"', ['""', "<broken>"]),
    ('a "b c', ["a", '"b c"', "<broken>"]),
    ("run 'abc", None),
    ("it's", ["it's"]),  # a quote inside a word opens nothing
]


def test_shell_tokens_match_the_standard_library(spark):
    """Texts that the standard lexer accepts as they stand give its tokens."""
    rng = random.Random(0)
    made = ['"a b" c "d"', 'x"y z"', '"a"b', "", "a  b\tc\n"]
    made += ["".join(rng.choices("ab \"'\t\\", k=rng.randint(0, 14))) for _ in range(20_000)]
    expected = {}
    for i, text in enumerate(made):
        lexer = shlex.shlex(text, posix=False)
        lexer.whitespace_split, lexer.commenters = True, ""
        with contextlib.suppress(ValueError):
            expected[i] = list(lexer)
    assert len(expected) > 5000
    df = column(spark, made)
    got = {r["i"]: r["tokens"] for r in fx.tokenize(df, "v").select("i", "tokens").collect()}
    one = {r["i"]: r["t"] for r in df.select("i", fx.shell_tokens(F.col("v")).alias("t")).limit(2000).collect()}
    assert {i: got[i] for i in expected} == expected
    assert {i: t for i, t in one.items() if i in expected} == {i: t for i, t in expected.items() if i in one}


def test_shell_tokens_of_open_quotes(spark):
    df = column(spark, [text for text, _ in OPEN_QUOTES])
    got = {r["i"]: r["tokens"] for r in fx.tokenize(df, "v").select("i", "tokens").collect()}
    assert [got[i] for i in range(len(OPEN_QUOTES))] == [tokens for _, tokens in OPEN_QUOTES]


def test_cmdline(spark):
    rows = spark.createDataFrame(
        [("c:\\x.exe", None), (None, "b"), ("c:\\y.exe", " -a ")], "p string, a string"
    )
    got = [r[0] for r in rows.select(fx.cmdline(F.col("p"), F.col("a"))).collect()]
    assert got == ['"c:\\x.exe"', None, '"c:\\y.exe"  -a']


@pytest.mark.parametrize("n,size", [(1, 99), (1, 100), (1, 101), (3, 95), (3, 96)])
def test_hover_text(spark, n, size):
    text = "x" * size
    row = spark.range(1).select(fx.hover_text(F.lit(n), F.lit(text))).first()[0]
    whole = ("(3x) " if n > 1 else "") + text
    assert row == (whole[:100] + "[...]" if len(whole) > 100 else whole)


def test_one_decimal_matches_printf(spark):
    rng = random.Random(1)
    values = [2.25, 0.35, 0.25, 0.05, 1.0, 0.0, 99.95, 1e-9] + [
        rng.choice([rng.uniform(0, 50), rng.randint(0, 4000) / 20, rng.randint(0, 999) / 8])
        for _ in range(3000)
    ]
    rows = column(spark, values, "double").select(
        "i", fx.bits_text(F.lit("n"), F.col("v")).alias("t")
    )
    for r in rows.collect():
        assert r["t"] == f"n {values[r['i']]:.1f}", values[r["i"]]


def test_args_and_labels(spark):
    row = spark.range(1).select(
        fx.args_of(F.lit('"c:\\a b.exe" -x "q r" z'), F.lit("a.exe")),
        fx.args_of(F.lit('"c:\\a.exe"'), F.lit("a.exe")),
        fx.unique_label(F.lit("t"), F.lit(2)),
        fx.unique_label(F.lit(""), F.lit(2)),
        fx.base_name(F.lit("c:\\lib\\k.dll")),
    ).first()
    assert list(row) == ['a.exe -x "q r" z', "a.exe", "t\u202d\u202d", "Unlabelled", "k.dll"]


def test_exclusion_drops_null_paths(spark):
    rows = column(spark, ["cmd>agent>init", "svc>init", "x>other-agent>init", None])
    assert [r["v"] for r in curate.exclude_subtrees(rows, "v", ["agent"]).collect()] == ["svc>init"]


@pytest.mark.parametrize("reject", [False, True])
def test_bins(spark, reject):
    times = ["03:10:00", "05:00:00", "07:59:59", "08:00:00"]
    rows = column(spark, [f"2023-11-05 {t}" for t in times]).select(
        F.col("v").cast("timestamp").alias("timestamp")
    )
    got = hosttime.time_bin(rows, reject_before_origin=reject).orderBy("timestamp").collect()
    want = [2, 5, 5, 8][1 if reject else 0 :]
    assert [r["bin"].hour for r in got] == want


def test_weights_of_known_bags(spark):
    even = spark.createDataFrame(
        [("a", "all", 2), ("a", "own", 2), ("b", "all", 1), ("b", "other", 1)],
        "row_id string, col_id string, n long",
    )
    got = {r["col_id"]: r["bits"] for r in weights.information_weights(even).collect()}
    assert got["all"] == pytest.approx(0.0, abs=1e-12)
    assert got["own"] == pytest.approx(math.log2(6 / 4))
    assert got["other"] == pytest.approx(math.log2(6 / 2))


def test_long_lists_continue_in_parts(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), F.col("id").alias("item")
    )
    parts = bags.collect_items(rows, "k", "item", limit=100).collect()
    assert max(len(r["items"]) for r in parts) < 300
    assert sorted(i for r in parts if r["k"] == "hot" for i in r["items"]) == list(range(900))
    assert [r["part"] for r in parts if r["k"] == "cold"] == [0]


def test_numbers_are_dense_and_ordered(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    got = bags.number_rows(rows.orderBy("v"), "i").collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["v"])] == list(range(5000))


def test_windows_stop_at_the_sequence_end(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "tokens array<string>")
    got = {(r["c1"], r["c2"]): r["w"] for r in cooccurrence.windowed_cooccurrence(rows, radius=2, kernel="harmonic").collect()}
    assert got == {("a", "b"): 1.0, ("b", "c"): 1.0, ("a", "c"): 0.5}


def test_absent_columns_can_top_a_cluster(spark):
    bag = spark.createDataFrame(
        [(r, "big", 50.0) for r in range(4)] + [(r, f"s{r}", 1.0) for r in range(4, 8)]
        + [(9, "p", 1.0), (9, "q", 1.0)],
        "row_id long, col_id string, w double",
    )
    groups = spark.createDataFrame(
        [(r, -1 if r < 4 else 0) for r in range(8)] + [(9, 1)], "id long, cluster int"
    )
    top = labels.top_items(labels.share_gaps(bag, groups)).collect()
    assert {(r["cluster"], r["col_id"]) for r in top if r["rank"] == 1} == {(0, "big"), (1, "big")}
    topics = {r["cluster"]: r["label"] for r in labels.cluster_topics(bag, groups).collect()}
    assert topics[-1] == "Unlabelled" and topics[0].startswith("<big\n>s")


def test_workload_thresholds(spark):
    spec = [("fifty", 50.0), ("six", 6.0), ("four", 4.0), ("half", 0.5)]
    bag = spark.createDataFrame(
        [("h", i, w) for i, (_, w) in enumerate(spec)], "row_id string, col_id long, w double"
    )
    runs = spark.createDataFrame(
        [("h", i, n, i, f"p{i}") for i, (n, _) in enumerate(spec)],
        "row_id string, obj_id long, name string, timestamp long, pid_hash string",
    )
    groups = spark.createDataFrame([("h", 0), ("x", -1)], "id string, cluster int")
    got = {r["cluster"]: r["label"] for r in labels.workload_labels(bag, groups, runs).collect()}
    assert got == {0: "fifty 50.0\nsix 6.0", -1: "Unlabelled"}

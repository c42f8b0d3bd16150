"""Quality rules: fixed limits first, then robust multivariate outliers (native)."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemap.session import cut

SPACE = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = (*STATS, "base_failed", "distance", "kept")

#: share of a group that its estimate rests on
SUBSET = 0.75
#: groups with fewer documents share one estimate
MIN_GROUP = 100
#: chance that a document of a normal group is rejected
ALPHA = 1e-8
#: concentration ends when no log determinant falls by more than this
STILL = 1e-3

_ok = {"w": "greatest(n_words, 1L)", "c": "greatest(word_chars, 1L)"}
#: transformed statistics, each with the spread that is never taken for an outlier's
FEATURES = {
    "log_words": ("ln({w})".format(**_ok), 0.5),
    "log_word_length": ("ln({c} / {w})".format(**_ok), 0.05),
    "symbol_share": ("least(n_symbols / {c}, 1.0D)".format(**_ok), 0.05),
    "log_dup_lines": ("ln(1 + n_dup_lines)", 0.7),
    "repeat_share": ("n_repeat_words / {w}".format(**_ok), 0.1),
}
P = len(FEATURES)
FLOOR = [floor for _, floor in FEATURES.values()]


def chi2(p: int, share: float) -> float:
    """Quantile of the chi-squared distribution (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(share) * (2 / (9 * p)) ** 0.5) ** 3


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of ``STATS`` (see ``judge_quality``); a null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACE))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = docs.withColumns(
        {
            "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES, -1)),
            "_lines": lines,
            "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        }
    )
    windows = "transform(slice(_words, 1, size(_words) - 2), (w, i) -> {}(w, _words[i + 1], _words[i + 2]))"
    step = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.when(F.size("_words") > 3, F.expr(windows.format("xxhash64"))),
        }
    ).drop("_lines")
    # Equal windows have equal hashes: only texts with a repeated hash compare their windows.
    step = step.withColumn(
        "_windows",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.expr(windows.format("concat_ws").replace("(w, _words", "(' ', w, _words")),
        ),
    ).drop("_hashes", "_words")
    step = step.withColumn(
        "_sorted", F.when(F.col("_windows").isNotNull(), F.expr("array_sort(transform(_windows, (t, i) -> struct(t, i)))"))
    ).drop("_windows")
    step = step.withColumn(
        "_twice",
        F.when(
            F.col("_sorted").isNotNull(),
            F.expr(
                "array_sort(transform(filter(_sorted, (s, k) ->"
                " s.t = get(_sorted, k - 1).t OR s.t = get(_sorted, k + 1).t), s -> s.i))"
            ),
        ),
    ).drop("_sorted")
    covered = F.expr(
        "aggregate(_twice, struct(0L AS n, -3 AS last),"
        " (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)"
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_twice")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def _x(j: int) -> Column:
    return F.col(f"x{j}")


def _whitening(moments: DataFrame, keys: list[str]) -> DataFrame:
    """``m*`` and the inverse Cholesky factor ``v*`` of covariance plus floor, with its log determinant.

    Column by column, so that no expression holds another twice.
    """
    t = moments
    for j in range(P):
        pivot = F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        t = t.withColumn(f"l{j}{j}", F.sqrt(F.greatest(pivot, F.lit(1e-12))))
        below = {
            f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)))
            / F.col(f"l{j}{j}")
            for i in range(j + 1, P)
        }
        t = t.withColumns(below) if below else t
    for i in range(P):
        new = {f"v{i}{i}": 1 / F.col(f"l{i}{i}")}
        for j in range(i):
            new[f"v{i}{j}"] = -sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")
        t = t.withColumns(new)
    spread = sum((F.ln(f"l{j}{j}") for j in range(P)), F.lit(0.0))
    return t.select(*keys, *[f"m{j}" for j in range(P)], *_V, spread.alias("spread"))


_V = [f"v{i}{j}" for i in range(P) for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimate."""
    parts = [sum((F.col(f"v{i}{j}") * (_x(j) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((part * part for part in parts), F.lit(0.0))


def _anew() -> Column:
    """The group's name as a new value: sums by it are dealt out afresh after a join by
    ``grp``, so that the join may split a group that holds many of the rows."""
    return F.concat_ws("", "grp").alias("grp")


def _reach(counted: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """For each key the smallest ``value`` up to which at least ``share`` of its rows lie."""
    order = Window.partitionBy(*keys).orderBy(value)
    run = counted.withColumn("until", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return run.filter(F.col("until") >= share * F.col("all")).groupBy(*keys).agg(F.min(value).alias("reach"))


def _medians(rows: DataFrame) -> DataFrame:
    """Median of each feature by group, to an eighth of its floor: counts by bin, no sorting of rows."""
    bins = F.array(*[F.struct(F.lit(j).alias("j"), F.round(_x(j) * 8 / FLOOR[j]).cast("long").alias("bin")) for j in range(P)])
    counted = rows.select("grp", F.explode(bins).alias("b")).select("grp", "b.*").groupBy("grp", "j", "bin").agg(F.count("*").alias("n"))
    reach = _reach(counted, ["grp", "j"], "bin", 0.5)
    pick = [F.max(F.when(F.col("j") == j, F.col("reach") * FLOOR[j] / 8)).alias(f"a{j}") for j in range(P)]
    return reach.groupBy("grp").agg(*pick)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """One estimate for each ``grp``: centre ``m*``, factor ``v*``, and ``scale``.

    Minimum covariance determinant by concentration steps from two fixed starts
    (medians with the floors as spread; mean and covariance of all rows). A step keeps
    the nearest ``SUBSET`` of a group, to a bin of 1/64 of the log distance, and takes
    the moments of what it kept; a start ends when its determinant falls by no more than
    ``STILL``. The start with the smaller determinant wins. A step is one aggregation:
    counts and sums by bin combine in the map task, so a group of any size costs one
    row for each task and bin, and the kept bins are then added up.
    """
    medians = cut(_medians(rows))
    # moments are taken about the medians, where they keep their digits
    near = cut(rows.join(medians, "grp").select("grp", *[(_x(j) - F.col(f"a{j}")).alias(f"x{j}") for j in range(P)]))
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = {f"m{j}": _x(j) for j in range(P)} | {f"s{i}{j}": _x(i) * _x(j) for i, j in pairs}
    adding = [F.sum(value).alias(name) for name, value in sums.items()]
    keys = ["grp", "start"]

    def estimate(summed: DataFrame) -> DataFrame:
        t = summed.withColumns({name: F.col(name) / F.col("n") for name in sums})
        cov = {
            f"c{i}{j}": F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOOR[i] ** 2 if i == j else 0.0)
            for i, j in pairs
        }
        return _whitening(t.withColumns(cov), [*keys, "old"])

    flat = {f"m{j}": F.lit(0.0) for j in range(P)} | {f"v{i}{j}": F.lit(1 / FLOOR[i] if i == j else 0.0) for i, j in pairs}
    first = medians.select("grp", F.lit(0).alias("start"), F.lit(1e9).alias("old")).withColumns(flat)
    first = first.withColumn("spread", F.lit(1e9))
    steps: list[DataFrame] = []
    every = near.groupBy("grp", F.lit(1).alias("start"), F.lit(1e9).alias("old")).agg(F.count("*").alias("n"), *adding)
    now = cut(first.unionByName(estimate(every).withColumn("spread", F.lit(1e9))))
    while True:  # a step that goes on lowers a determinant by more than STILL, and floors bound it
        far = near.join(now.withColumn("old", F.col("spread")), "grp").withColumn("bin", F.floor(64 * F.log1p(_distance())))
        binned = far.groupBy(_anew(), "start", "old", "bin").agg(F.count("*").alias("n"), *adding)
        order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        inside = (
            binned.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0)))
            .withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
            .filter(F.col("below") < SUBSET * F.col("all"))
        )
        kept = inside.groupBy(*keys, "old").agg(F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in sums])
        step = cut(estimate(kept))
        steps.append(step)
        now = step.filter((F.col("old") - F.col("spread") > STILL) & ~F.isnan("spread"))
        if not now.limit(1).count():
            break
    every = reduce(DataFrame.union, steps)
    fields = F.struct(*[c for c in every.columns if c != "grp"])
    best = every.groupBy("grp").agg(F.min_by(fields, F.struct("spread", "start", "old")).alias("b"))
    best = cut(best.select("grp", "b.*"))
    binned = near.join(best, "grp").withColumn("bin", F.floor(64 * F.log1p(_distance())))
    reach = _reach(binned.groupBy(_anew(), "bin").agg(F.count("*").alias("n")), ["grp"], "bin", SUBSET)
    # the kept share is too narrow for a normal group by this much; never drawn in
    scale = F.greatest(F.lit(1.0), F.expm1((F.col("reach") + 1) / 64) / chi2(P, SUBSET))
    back = [(F.col(f"m{j}") + F.col(f"a{j}")).alias(f"m{j}") for j in range(P)]
    made = best.join(medians, "grp").join(reach, "grp").select("grp", *back, *_V, scale.alias("scale"))
    return cut(made)


def judge_statistics(rows: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Adds ``base_failed``, ``distance`` and ``kept`` to a table with ``STATS`` and the columns ``by``."""
    name = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in by])
    rows = cut(
        rows.withColumn("base_failed", base_failed())
        .withColumn("named", name)
        .withColumns({f"x{j}": F.expr(f"CAST({text} AS DOUBLE)") for j, (text, _) in enumerate(FEATURES.values())})
    )
    judged = rows.filter("NOT base_failed")
    groups = cut(
        judged.groupBy("named")
        .agg(F.count("*").alias("n"))
        .select("named", F.when(F.col("n") >= MIN_GROUP, F.col("named")).otherwise("\x03").alias("grp"))
    )
    estimates = robust_estimates(judged.join(groups, "named").select("grp", *[f"x{j}" for j in range(P)]))
    found = groups.join(estimates, "grp").drop("grp")
    d2 = _distance() / F.col("scale")
    out = rows.join(cut(found), "named", "left").withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(d2)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2(P, 1 - ALPHA) ** 0.5, F.lit(True))
    return out.withColumn("kept", kept).drop("named", *[f"x{j}" for j in range(P)], *[f"m{j}" for j in range(P)], *_V, "scale")


def judge_quality(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``row`` (a struct of the document's columns) with ``STATS``, ``base_failed``, ``distance`` and ``kept``.

    Words are runs of other than white space. ``word_chars``: code points in words;
    ``n_symbols``: characters of ``#*$%&|<>``; ``n_dup_lines``: lines with a word that
    equal an earlier one; ``n_repeat_words``: words in three-word windows that the text
    holds twice or more. A document fails outright with fewer than 50 words, or when
    more than half of its words are repeated. The others are measured against their
    ``by`` group (null is a value of its own): beyond the quantile ``1 - ALPHA`` of
    their squared robust distance they are rejected. Groups of fewer than ``MIN_GROUP``
    share one estimate. Null and empty texts fail. Every row is judged by itself, so
    repeated rows share a verdict; an empty table gives an empty result.
    """
    packed = docs.select(
        F.struct("*").alias("row"), F.col(text).alias("_text"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    )
    keys = tuple(f"_by{i}" for i in range(len(by)))
    return judge_statistics(base_statistics(packed, "_text").drop("_text"), keys).drop(*keys)

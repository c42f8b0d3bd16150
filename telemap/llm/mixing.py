"""Mixing to target weights: soft domains from labels, then document rates by projected gradient."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.llm.rows import send
from telemap.llm.words import PLAIN, slices, words
from telemap.session import cut

#: labelled rows that the classifier is fitted on, at most; one half fits, one half calibrates
SAMPLE = 20_000
#: hashed features: words and the first ``STEM`` bytes of words
FEATURES, STEM = 1 << 17, 6
#: ridge and steps of the fit
RIDGE, STEPS = 1.0, 150
MAX_STEPS = 60
#: a feature speaks for or against a domain from this many standard errors on
CLEAR = 3.5
#: the steps end when no domain's total moves by more than this share of it
STILL = 1e-6

Domain = tuple[int, int]


def default_factor(domain: Domain) -> float:
    """Wanted tokens of a (quality, toxic) domain as a multiple of what there is."""
    return 0.25 if domain[1] else 1.02


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and feature of every different word and stem, and word counts.

    Words count as written, one half of the features; stems in lower case, the other.
    """
    found = words(column, PLAIN, STEM)
    half = np.uint64(FEATURES // 2)
    owner = found.owner().astype(np.uint64) * np.uint64(FEATURES)
    both = np.concatenate((owner | found.hashes & (half - np.uint64(1)), owner | half | found.stems & (half - np.uint64(1))))
    pairs = np.unique(both)
    return (pairs // np.uint64(FEATURES)).astype(np.int64), (pairs % np.uint64(FEATURES)).astype(np.int64), found.counts


class Classifier:
    """Multinomial logistic regression on the features that set a domain apart."""

    def __init__(self, counts: np.ndarray) -> None:
        base = (counts.sum(axis=0) + 1.0) / (counts.sum() + FEATURES)
        expected = counts.sum(axis=1, keepdims=True) * base
        clear = np.abs(counts - expected) >= CLEAR * np.sqrt(np.maximum(expected, 1.0))
        self.clear = clear.any(axis=0)
        self.weights = np.zeros((FEATURES, len(counts)))
        self.offsets = np.zeros(len(counts))
        self.heat = 1.0

    def learn(self, row: np.ndarray, feature: np.ndarray, domain: np.ndarray) -> None:
        """Full-batch Adam on the log loss plus a ridge; one row for each pair of text and clear feature."""
        used, place = np.unique(feature, return_inverse=True)
        width = len(self.offsets)
        wanted = np.eye(width)[domain]
        w = np.zeros((len(used) + 1, width))
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            score = np.stack([np.bincount(row, w[place, d], minlength=len(domain)) for d in range(width)], axis=1) + w[-1]
            p = np.exp(score - score.max(axis=1, keepdims=True))
            error = p / p.sum(axis=1, keepdims=True) - wanted
            slope = np.zeros_like(w)
            for d in range(width):
                slope[:-1, d] = np.bincount(place, error[row, d], minlength=len(used))
            slope[-1] = error.sum(axis=0)
            slope[:-1] += RIDGE * w[:-1]
            mean = 0.9 * mean + 0.1 * slope
            square = 0.99 * square + 0.01 * slope**2
            w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        self.weights[used] = w[:-1]
        self.offsets = w[-1]

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row, feature, counts = _features(column)
        row, feature = row[self.clear[feature]], feature[self.clear[feature]]
        out = np.zeros((len(column), self.weights.shape[1]))
        for d in range(out.shape[1]):
            out[:, d] = np.bincount(row, self.weights[feature, d], minlength=len(column))
        return out, counts

    def posterior(self, evidence: np.ndarray) -> np.ndarray:
        score = self.heat * evidence + self.offsets
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def calibrate(self, evidence: np.ndarray, domain: np.ndarray) -> None:
        """Temperature with the least log loss on rows that were not fitted on."""
        if not len(domain):
            return
        losses = []
        heats = np.exp(np.linspace(math.log(0.02), math.log(2.0), 60))
        for self.heat in heats:
            own = self.posterior(evidence)[np.arange(len(domain)), domain]
            losses.append(-np.log(np.maximum(own, 1e-300)).mean())
        self.heat = float(heats[int(np.argmin(losses))])


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, quality, toxic, half``: at most ``SAMPLE`` labelled documents, chosen by a hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int"), F.col("toxic").cast("int")).dropna()
    chosen = (
        known.groupBy("doc_id")
        .agg(F.max(F.struct("quality", "toxic")).alias("l"))
        .select("doc_id", "l.*", F.xxhash64("doc_id", F.lit(7)).alias("h"))
        .orderBy("h", "doc_id")
        .limit(SAMPLE)
    )
    chosen = F.broadcast(chosen.select("doc_id", "quality", "toxic", F.pmod("h", F.lit(2)).alias("half")))
    return docs.join(chosen, "doc_id").select("text", "quality", "toxic", "half")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[Domain], Classifier | None]:
    """Domains of the sample, and a classifier of them (none without labelled documents)."""
    sample = cut(labelled_sample(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels))
    seen = sample.groupBy("quality", "toxic").agg(F.count("*").alias("n")).collect()
    domains = sorted((r["quality"], r["toxic"]) for r in seen)
    if not domains:
        return [], None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            row, feature, _ = _features(batch.column(0))
            names = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            domain = np.array([domains.index(x) for x in names], dtype=np.int64)
            key, n = np.unique(domain[row] * FEATURES + feature, return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "n": pa.array(n.astype(np.int64))})

    def rows(half: int) -> DataFrame:
        return sample.filter(F.col("half") == half).select("text", "quality", "toxic")

    summed = rows(0).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(domains), FEATURES))
    counts.flat[summed["key"].to_numpy()] = summed["n"].to_numpy(dtype=float)
    model = Classifier(counts)
    start = send(docs.sparkSession, model)  # features times domains, whatever the input

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear = start().clear
        for batch in slices(batches, 0):
            row, feature, _ = _features(batch.column(0))
            row, feature = row[clear[feature]], feature[clear[feature]]
            names = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "domain": pa.array([domains.index(x) for x in names], pa.int64()),
                    "features": pa.ListArray.from_arrays(pa.array(ends), pa.array(feature, pa.int64())),
                }
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, parts = start(), list(batches)
        if parts:
            domain = np.concatenate([b.column(0).to_numpy() for b in parts])
            lists = [np.asarray(b.column(1).value_lengths()) for b in parts]
            feature = np.concatenate([np.asarray(b.column(1).flatten()) for b in parts])
            fitted.learn(np.repeat(np.arange(len(domain)), np.concatenate(lists)), feature, domain)
        yield pa.RecordBatch.from_pydict(
            {"weights": pa.array([fitted.weights.tobytes()], pa.binary()), "offsets": pa.array([fitted.offsets.tobytes()], pa.binary())}
        )

    # half the bounded sample, as lists of clear features, in one task
    few = rows(0).mapInArrow(pairs, "domain long, features array<long>").repartition(1)
    learnt = few.mapInArrow(learn, "weights binary, offsets binary").first()
    if learnt is not None:
        model.weights = np.frombuffer(bytes(learnt["weights"])).reshape(FEATURES, -1)
        model.offsets = np.frombuffer(bytes(learnt["offsets"]))
    sent = send(docs.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent()
        for batch in slices(batches, 0):
            names = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_pydict(
                {
                    "domain": pa.array([domains.index(x) for x in names], pa.int64()),
                    "evidence": pa.array(list(known.evidence(batch.column(0))[0]), pa.list_(pa.float64())),
                }
            )

    held = rows(1).mapInArrow(score, "domain long, evidence array<double>").toPandas()  # half the sample at most
    if len(held):
        model.calibrate(np.stack(held["evidence"].to_numpy()), held["domain"].to_numpy())
    return domains, model


def with_posteriors(docs: DataFrame, carry: list[str], model: Classifier | None, text: str = "text") -> DataFrame:
    """``row`` (a struct of the columns ``carry``), ``n_tokens`` and ``posterior``."""
    source = docs.select(F.struct(*carry).alias("row"), F.col(text).cast("string").alias("text"))
    sent = send(docs.sparkSession, model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent()
        for batch in slices(batches, "text"):
            if known is None:
                counts = words(batch.column("text"), PLAIN).counts
                posterior = np.zeros((batch.num_rows, 0))
            else:
                evidence, counts = known.evidence(batch.column("text"))
                posterior = known.posterior(evidence)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * posterior.shape[1]
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column("row"),
                    "n_tokens": pa.array(counts),
                    "posterior": pa.ListArray.from_arrays(pa.array(ends), pa.array(posterior.ravel(), pa.float64())),
                }
            )

    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(predict, f"row {kind}, n_tokens long, posterior array<double>")


def rates(posterior: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Document rates after gradient ``steps``, each projected on what is not negative."""
    rate = np.ones(len(posterior))
    for step in steps:
        rate = np.maximum(0.0, rate - posterior @ step)
    return rate


def _posteriors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), dtype=np.float64).reshape(-1, width)


def fit_rates(table: DataFrame, domains: list[Domain], factor: Callable[[Domain], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient steps, wanted totals and reached totals.

    Minimises the squared error of expected domain totals, relative to the present
    totals, over nonnegative rates, from 1 for every document. In the metric that
    weighs documents by their tokens the gradient for a document is its posterior times
    the relative errors, and the largest eigenvalue is 1, so the step length is 1. A
    round is one pass that sums a number for each domain; a document's rate follows
    from its posterior and the steps so far, so no rates are kept between rounds. Rounds end
    when no total moves by more than ``STILL`` of what it was, or after ``MAX_STEPS``: where
    posteriors overlap much the last digits of the fit would take thousands of rounds.
    """
    width = len(domains)

    def totals(steps: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                p = _posteriors(batch, "posterior", width)
                total += (batch.column("n_tokens").to_numpy() * rates(p, steps)) @ p
            yield pa.RecordBatch.from_pydict({"domain": pa.array(np.arange(width)), "total": pa.array(total)})

        parts = table.select("n_tokens", "posterior").mapInArrow(add, "domain long, total double")
        summed = {r["domain"]: r["total"] for r in parts.groupBy("domain").agg(F.sum("total").alias("total")).collect()}
        return np.array([summed.get(d, 0.0) for d in range(width)])

    steps = np.zeros((0, width))
    present = reached = totals(steps)
    wanted = present * np.array([factor(d) for d in domains])
    scale = np.maximum(present, 1e-12 * max(present.sum(), 1.0))
    for _ in range(MAX_STEPS):
        steps = np.vstack((steps, (reached - wanted) / scale))
        after = totals(steps)
        moved = np.abs(after - reached) / scale
        reached = after
        if moved.max() <= STILL:
            break
    return steps, wanted, reached


def mix(
    docs: DataFrame,
    labels: DataFrame,
    factor: Callable[[Domain], float] = default_factor,
    carry: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """``row, n_tokens, posterior, domain, rate, copies``: a row for each row of ``docs``.

    Domains are the (quality, toxic) pairs of ``labels``; rows with a null count for
    nothing, and of several labels of a document the largest counts. Posteriors come
    from a logistic classifier on different words and stems, calibrated on the half of the
    sample it was not fitted on. Rates are fitted so that expected domain totals of
    tokens meet ``factor`` times the present ones; ``copies`` rounds a rate up or down
    by a hash of the row, so the result is the same in every run. ``domain`` is the
    place of the likeliest domain. Texts without known features have the posterior of the offsets.
    Without labelled documents there are no domains and every rate is 1.
    """
    carry = docs.columns if carry is None else carry
    domains, model = fit(docs.withColumn("text", F.col(text)), labels)
    table = cut(with_posteriors(docs, carry, model, text))
    luck = (F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("luck")
    if not domains:
        return table.withColumns({"domain": F.lit(None).cast("int"), "rate": F.lit(1.0), "copies": F.lit(1).cast("long")})
    steps, _, _ = fit_rates(table, domains, factor)
    width = len(domains)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _posteriors(batch, "posterior", width)
            rate = rates(p, steps)
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("row", "n_tokens", "posterior")}
                | {
                    "domain": pa.array(p.argmax(axis=1).astype(np.int32)),
                    "rate": pa.array(rate),
                    "copies": pa.array(np.floor(rate + batch.column("luck").to_numpy()).astype(np.int64)),
                }
            )

    kind = table.schema["row"].dataType.simpleString()
    return table.select("row", "n_tokens", "posterior", luck).mapInArrow(
        settle, f"row {kind}, n_tokens long, posterior array<double>, domain int, rate double, copies long"
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as its rate says."""
    times = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return mixed.filter("copies > 0").select("row", F.explode(times).alias("nth")).select("row.*")

"""Removal of repeated passages by level-wise doubling.

A passage of ``window`` words that occurs twice has, in both places, the same smallest
half-length run among its half-length runs. So at the first level (half a window) only
such local minima are kept as anchors, about one in thirteen. Anchors that a second
document holds are extended to windows, and repeated windows at anchors on to twice,
four times, ... their length until none is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.llm.rows import keyed
from telemap.llm.words import PLAIN, RUN_BASES, Runs, Words, mix, slices, words
from telemap.session import cut, forget

WINDOW = 50


def anchors(found: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, and the start of the smallest half-length run in each.

    Then the places so chosen, in order, and the hashes of their runs. Texts shorter
    than ``window`` have no window. Of equal runs the first counts.
    """
    half = window // 2
    span = window - half + 1  # half-length runs in a window
    many = np.maximum(found.counts - half + 1, 0)
    many[found.counts < window] = 0
    total = int(many.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    ends = np.concatenate(([0], np.cumsum(many)))
    place = np.repeat(found.ends[:-1] - ends[:-1], many) + np.arange(total)
    value = Runs(found.hashes).of(place, half)
    # minima over ``span`` neighbours by doubling, then the first place that has each
    low, width = value.copy(), 1
    while width < span:
        step = min(width, span - width)
        low[:-step] = np.minimum(low[:-step], low[step:])
        width += step
    last = np.repeat(ends[1:], many)
    windows = np.flatnonzero(np.arange(total) + span <= last)
    own = windows.copy()
    seek = np.arange(len(windows))
    while len(seek):
        seek = seek[value[own[seek]] != low[windows[seek]]]
        own[seek] += 1
    chosen = np.zeros(total, dtype=bool)
    chosen[own] = True
    return place[windows], place[own], place[chosen], value[chosen]


FIRST = "doc_id long, ord long, th long, n_words long, w1 long, w2 long, anchors array<long>"
SECOND = (
    "doc_id long, ord long, th long, n_words long, kept_sha256 string, kept_text string, text string,"
    " places array<int>, k1 array<long>, k2 array<long>, longer array<array<long>>"
)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def first_level(docs: DataFrame, window: int) -> DataFrame:
    """For each row of a ``keyed`` table: hashes of its whole word sequence and of its anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = words(batch.column("text"), PLAIN)
            whole = [Runs(found.hashes, b).of(found.ends[:-1], found.counts).view(np.int64) for b in RUN_BASES]
            *_, place, value = anchors(found, window)
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("doc_id", "ord", "th")}
                | {
                    "n_words": pa.array(found.counts),
                    "w1": pa.array(whole[0]),
                    "w2": pa.array(whole[1]),
                    "anchors": _lists(value.view(np.int64), np.searchsorted(place, found.ends), pa.int64()),
                }
            )

    return docs.select("doc_id", "ord", "th", "text").mapInArrow(scan, FIRST)


def digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def second_level(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    """Windows whose own anchor is repeated, with both hashes; whole texts where there are any.

    ``docs`` has the repeated anchors of each text in ``repeated`` (null: none). A text
    without candidates is finished here. ``longer`` has, for each candidate at an
    anchor, the hashes of runs of twice, four times, ... its length, as far as every
    window in them is a candidate.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = words(batch.column("text"), PLAIN)
            every, own, place, value = anchors(found, window)
            owner = np.searchsorted(found.ends, place, "right") - 1
            known = batch.column("repeated")
            flat = np.asarray(known.flatten(), dtype=np.int64).view(np.uint64)
            sizes = np.array([len(x) if x.is_valid else 0 for x in known], dtype=np.int64)
            row = np.repeat(np.arange(len(known)), sizes)
            # a clash of these 64-bit keys only lets a needless candidate through
            good = np.isin(mix(value ^ mix(owner.astype(np.uint64) + np.uint64(1))), mix(flat ^ mix(row.astype(np.uint64) + np.uint64(1))))
            candidate = good[np.searchsorted(place, own)]
            start, ended = every[candidate], every[~candidate]
            runs = [Runs(found.hashes, b) for b in RUN_BASES]
            keys = [(r.of(start, window) if len(start) else np.zeros(0, np.uint64)).view(np.int64) for r in runs]
            stop = np.searchsorted(start, found.ends)
            # doubling from candidates that begin at an anchor
            from_anchor = np.isin(start, place)
            ahead = np.append(ended, len(found.hashes) + window)
            text_end = found.ends[np.searchsorted(found.ends, start, "right")]
            limit = np.minimum(ahead[np.searchsorted(ahead, start)] + window - 1, text_end) - start
            length, doubled = 2 * window, []
            while True:
                at = np.flatnonzero(from_anchor & (limit >= length))
                if not len(at):
                    break
                doubled.append((at, runs[0].of(start[at], length).view(np.int64)))
                length *= 2
            which = np.concatenate([at for at, _ in doubled] or [np.zeros(0, np.int64)])
            hashes = np.concatenate([h for _, h in doubled] or [np.zeros(0, np.int64)])
            order = np.argsort(which, kind="stable")  # by window, then by level
            levels = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(start)))))
            raw = batch.column("text").to_pylist()
            busy = np.diff(stop) > 0
            shas, kept = [], []
            for i, text in enumerate(raw):
                own = None if busy[i] else (text or "").encode().split()
                shas.append(None if own is None else digest(own))
                kept.append(None if own is None or not texts else b" ".join(own).decode())
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("doc_id", "ord", "th")}
                | {
                    "n_words": pa.array(found.counts),
                    "kept_sha256": pa.array(shas, pa.string()),
                    "kept_text": pa.array(kept, pa.string()),
                    "text": pa.array([t if b else None for t, b in zip(raw, busy)], pa.string()),
                    "places": _lists((start - found.ends[np.searchsorted(found.ends, start, "right") - 1]).astype(np.int32), stop, pa.int32()),
                    "k1": _lists(keys[0], stop, pa.int64()),
                    "k2": _lists(keys[1], stop, pa.int64()),
                    "longer": pa.ListArray.from_arrays(
                        pa.array(stop.astype(np.int32)), _lists(hashes[order], levels, pa.int64())
                    ),
                }
            )

    return docs.select("doc_id", "ord", "th", "text", "repeated").mapInArrow(scan, SECOND)


RESULT = "doc_id long, ord long, th long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:int,end:int>>"


def without_spans(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    """Takes the words out that a window from ``starts`` (null: none) covers."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: dict[str, list] = {name: [] for name in ("n_words", "n_removed", "kept_sha256", "kept_text", "spans")}
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                own = text.encode().split()
                change = np.zeros(len(own) + 1, dtype=np.int64)
                at = np.array(starts or [], dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = [w for w, g in zip(own, gone.tolist()) if not g]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
                out["n_words"].append(len(own))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(digest(kept))
                out["kept_text"].append(b" ".join(kept).decode() if texts else None)
                out["spans"].append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("doc_id", "ord", "th")}
                | {
                    "n_words": pa.array(out["n_words"], pa.int64()),
                    "n_removed": pa.array(out["n_removed"], pa.int64()),
                    "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                    "kept_text": pa.array(out["kept_text"], pa.string()),
                    "spans": pa.array(out["spans"], pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))),
                }
            )

    return docs.select("doc_id", "ord", "th", "text", "starts").mapInArrow(strip, RESULT)


def _in_several(keys: DataFrame, by: list[str]) -> DataFrame:
    """Keys that documents of different ids hold, with the smallest id."""
    held = keys.groupBy(*by).agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    return held.filter("first < last").drop("last")


def longest_repeats(starts: DataFrame, window: int) -> DataFrame:
    """``ord, th, longest``: the greatest level at which a run of the document is repeated.

    ``starts`` has a row for each repeated window at an anchor, with the hashes of its
    longer runs. A level looks only at what was repeated at the level before.
    """
    alive, length = cut(starts), window
    reached = alive.groupBy("ord", "th").agg(F.lit(window).alias("longest"))
    level = 0
    while True:
        keys = alive.filter(F.size("longer") > level).withColumn("key", F.col("longer")[level])
        twice = cut(_in_several(keys, ["key"]))
        if not twice.limit(1).count():
            forget(twice)
            break
        length *= 2
        level += 1
        following = cut(keys.join(twice.select("key"), "key", "left_semi").drop("key"))
        reached = reached.union(following.groupBy("ord", "th").agg(F.lit(length).alias("longest")))
        alive = following
    return cut(reached.groupBy("ord", "th").agg(F.max("longest").alias("longest")))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", texts: bool = True
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text, spans, longest``: a row for each row of ``docs``.

    Words are runs of other than white space. A word goes when one of the runs of
    ``window`` words that cover it also starts in a row with a smaller id; runs are
    judged on the input. ``kept_text`` (null unless ``texts``) joins what is left by one
    space, ``spans`` are the removed stretches in words. A row whose whole sequence
    comes in a row with a smaller id takes no part in the search: it loses every word.
    ``longest`` is the greatest of ``window`` times 1, 2, 4, ... at which a run that
    starts at an anchor is repeated in a different text, or fits into a text removed
    whole; null if nothing is repeated. Rows without an id come after all others; rows
    that share an id do not affect each other. Null and empty texts have no words.
    Windows are compared by 128-bit hashes.
    """
    rows = keyed(docs, key, text)
    scanned = cut(first_level(rows, window))
    whole = cut(_in_several(scanned.filter(F.col("n_words") >= window), ["w1", "w2"]))
    marked = cut(
        scanned.join(whole, ["w1", "w2"], "left")
        .withColumn("copy", F.coalesce(F.col("ord") > F.col("first"), F.lit(False)))
        .drop("w1", "w2", "first")
    )
    forget(scanned)
    leaders = marked.filter("NOT copy")
    held = leaders.select("ord", "th", F.explode("anchors").alias("anchor"))
    twice = cut(_in_several(held, ["anchor"]).select("anchor"))
    repeated = held.join(twice, "anchor", "left_semi").groupBy("ord", "th").agg(F.collect_list("anchor").alias("repeated"))
    info = cut(leaders.select("ord", "th").distinct().join(repeated, ["ord", "th"], "left"))
    second = cut(second_level(rows.join(info, ["ord", "th"]), window, texts))
    forget(info, twice)

    pending = second.filter(F.col("text").isNotNull())
    at = pending.select("ord", "th", F.explode(F.arrays_zip("places", "k1", "k2", "longer")).alias("w")).select("ord", "th", "w.*")
    shared = cut(_in_several(at.select("ord", "k1", "k2"), ["k1", "k2"]))
    hits = cut(at.join(shared, ["k1", "k2"]).select("ord", "th", F.col("places").alias("place"), "first", "longer"))
    forget(shared)
    starts = hits.filter("ord > first").groupBy("ord", "th").agg(F.collect_list("place").alias("starts"))
    stripped = without_spans(pending.select("doc_id", "ord", "th", "text").join(starts, ["ord", "th"], "left"), window, texts)
    none = F.array().cast("array<struct<start:int,end:int>>")
    finished = second.filter(F.col("text").isNull()).select(
        "doc_id", "ord", "th", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "kept_text", none.alias("spans")
    )
    doubled = longest_repeats(hits.select("ord", "th", "longer"), window)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans", "longest"]
    level = F.expr(f"{window} * shiftleft(1, CAST(floor(log2(n_words / {window})) AS INT))")
    copies = marked.filter("copy").select(
        "doc_id",
        "n_words",
        F.col("n_words").alias("n_removed"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"),
        F.lit("" if texts else None).cast("string").alias("kept_text"),
        F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).alias("spans"),
        level.alias("longest"),
    )
    others = stripped.unionByName(finished).join(doubled, ["ord", "th"], "left").select(*columns)
    return others.unionByName(copies.select(*columns))

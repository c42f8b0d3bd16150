"""Benchmark decontamination on a distributed positional inverted index.

The index has one row for each segment of the training table (whole documents, about
``SEGMENT`` words): its terms, where their postings end, and the word positions, all
packed. Phrases are asked in blocks of bounded size; a block goes to every segment,
where lists are intersected from the rarest term on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.llm.rows import send
from telemap.llm.words import LETTERS, slices, words
from telemap.session import cut

SEGMENT = 1 << 18
WINDOW = 13
#: (item, window) pairs that one block of questions holds
BLOCK = 50_000
#: candidates looked at together
CHUNK = 1 << 20
#: a proximity match has all words of a window within this many words of its rarest one
NEAR = 20

INDEX = "segment long, ids array<long>, ths array<long>, sizes array<int>, terms binary, ends binary, positions binary"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of every word of every document, written to the shared folder.

    A document without words, or without text, is kept in ``ids`` with size 0.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) - 1
        for batch in slices(batches, 1):
            found = words(batch.column(1), LETTERS)
            ids, ths = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at = 0
            while at < len(found):
                to = max(at + 1, int(np.searchsorted(found.ends, found.ends[at] + SEGMENT, "right")) - 1)
                hashes = found.hashes[found.ends[at] : found.ends[to]]
                order = np.argsort(hashes, kind="stable")
                terms, first = np.unique(hashes[order], return_index=True)
                number += 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([number], pa.int64()),
                        "ids": pa.array([ids[at:to]], pa.list_(pa.int64())),
                        "ths": pa.array([ths[at:to]], pa.list_(pa.int64())),
                        "sizes": pa.array([np.diff(found.ends[at : to + 1]).astype(np.int32)], pa.list_(pa.int32())),
                        "terms": pa.array([terms.tobytes()], pa.binary()),
                        "ends": pa.array([np.append(first[1:], len(hashes)).astype(np.int32).tobytes()], pa.binary()),
                        "positions": pa.array([order.astype(np.int32).tobytes()], pa.binary()),
                    }
                )
                at = to

    source = docs.select(F.col(key).cast("long"), F.col(text).cast("string"), F.xxhash64(F.col(text)))
    return cut(source.mapInArrow(segments, INDEX))


def phrase_windows(items: DataFrame, size: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item, window`` (packed word hashes): runs of ``size`` words; a shorter item is one run.

    An item without an id goes by the empty string.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words(batch.column(1), LETTERS)
            names, windows = [], []
            for i, name in enumerate(batch.column(0).to_pylist()):
                own = found.of(i)
                for at in range(max(len(own) - size + 1, min(len(own), 1))):
                    names.append(name)
                    windows.append(own[at : at + size].tobytes())
            yield pa.RecordBatch.from_pydict({"item": pa.array(names, pa.string()), "window": pa.array(windows, pa.binary())})

    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text).cast("string"))
    return named.mapInArrow(runs, "item string, window binary").distinct()


class Phrases:
    """One block of different windows: their terms, the order of rarity, their items."""

    def __init__(self, pairs: list[tuple[str, bytes]], size: int) -> None:
        by_window: dict[bytes, list[str]] = {}
        for item, window in pairs:
            by_window.setdefault(bytes(window), []).append(item)
        self.items = list(by_window.values())
        self.length = np.array([len(w) // 8 for w in by_window], dtype=np.int64)
        self.terms = np.zeros((len(by_window), size), dtype=np.uint64)
        for row, window in enumerate(by_window):
            self.terms[row, : len(window) // 8] = np.frombuffer(window, dtype=np.uint64)
        self.used = np.arange(size) < self.length[:, None]
        self.vocabulary = np.unique(self.terms[self.used])
        self.order = np.tile(np.arange(size), (len(by_window), 1))

    def rank(self, counts: dict[int, int]) -> None:
        """Order the offsets of each window by how often the corpus holds their term."""
        often = np.array([counts.get(int(t), 0) for t in self.vocabulary.view(np.int64)], dtype=np.int64)
        held = np.where(self.used, often[np.minimum(np.searchsorted(self.vocabulary, self.terms), len(often) - 1)], 1 << 62)
        self.order = np.argsort(held, axis=1, kind="stable")


class Segment:
    """Postings of one segment."""

    def __init__(self, sizes: np.ndarray, terms: bytes, ends: bytes, positions: bytes) -> None:
        self.terms = np.frombuffer(terms, dtype=np.uint64)
        self.ends = np.concatenate(([0], np.frombuffer(ends, dtype=np.int32))).astype(np.int64)
        self.positions = np.frombuffer(positions, dtype=np.int32).astype(np.int64)
        self.begins = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        owner = np.repeat(np.arange(len(self.terms)), np.diff(self.ends))
        self.places = (owner << 32) | self.positions  # sorted: by term, then by position

    def ids_of(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term here, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) | position
        at = np.minimum(np.searchsorted(self.places, key), len(self.places) - 1)
        return (self.places[at] == key) & (position >= 0)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, position, "right") - 1

    def candidates(self, asked: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows whose terms all occur, with each posting of their rarest term, by chunks."""
        ids = self.ids_of(asked.terms)
        rows = np.flatnonzero(((ids >= 0) | ~asked.used).all(axis=1))
        if not len(rows):
            return
        rarest = ids[rows, asked.order[rows, 0]]
        begin, many = self.ends[rarest], self.ends[rarest + 1] - self.ends[rarest]
        done = np.concatenate(([0], np.cumsum(many)))
        for low in range(0, int(done[-1]), CHUNK):
            flat = np.arange(low, min(low + CHUNK, int(done[-1])))
            row = np.searchsorted(done, flat, "right") - 1
            yield ids, rows[row], self.positions[begin[row] + flat - done[row]]

    def exact(self, asked: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Window and start of every occurrence inside one document."""
        windows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ids, row, position in self.candidates(asked):
            start = position - asked.order[row, 0]
            for nth in range(1, asked.order.shape[1]):
                offset = asked.order[row, nth]
                ok = (nth >= asked.length[row]) | self.has(ids[row, offset], start + offset)
                row, start = row[ok], start[ok]
            ok = (start >= 0) & (self.doc_of(start) == self.doc_of(start + asked.length[row] - 1))
            windows.append(row[ok])
            starts.append(start[ok])
        return np.concatenate(windows), np.concatenate(starts)

    def near(self, asked: Phrases, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Window and place of its rarest term wherever all its terms lie within ``reach``."""
        windows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ids, row, position in self.candidates(asked):
            for nth in range(1, asked.order.shape[1]):
                doc = self.doc_of(position)
                low = np.maximum(position - reach, self.begins[doc])
                high = np.minimum(position + reach, self.begins[doc + 1] - 1)
                term = ids[row, asked.order[row, nth]]
                at = np.minimum(np.searchsorted(self.places, (term << 32) | low), len(self.places) - 1)
                ok = (nth >= asked.length[row]) | ((self.places[at] >= ((term << 32) | low)) & (self.places[at] <= ((term << 32) | high)))
                row, position = row[ok], position[ok]
            windows.append(row)
            places.append(position)
        return np.concatenate(windows), np.concatenate(places)


MATCHES = (
    "segment long, nth int, spans array<struct<start:int,length:int>>, items array<string>, near_items array<string>"
)


def _term_counts(index: DataFrame, asked) -> dict[int, int]:
    """How often the corpus holds each term of a block."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = asked().vocabulary
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                here = np.frombuffer(terms.as_py(), dtype=np.uint64)
                many = np.diff(np.concatenate(([0], np.frombuffer(ends.as_py(), dtype=np.int32))))
                _, a, b = np.intersect1d(vocabulary, here, assume_unique=True, return_indices=True)
                total[a] += many[b]
        some = total > 0
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(vocabulary[some].view(np.int64)), "n": pa.array(total[some])}
        )

    summed = index.select("terms", "ends").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in summed.collect()}  # at most the words of one block


def _ask(index: DataFrame, asked, reach: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = asked()
        for batch in batches:
            for segment, sizes, *packed in zip(*batch.columns):
                here = Segment(np.array(sizes.as_py(), dtype=np.int64), *[p.as_py() for p in packed])
                window, start = here.exact(block)
                near_window, place = here.near(block, reach)
                found: dict[int, tuple[set, set, set]] = {}
                for w, s, d in zip(window.tolist(), start.tolist(), here.doc_of(start).tolist()):
                    spans, items, _ = found.setdefault(d, (set(), set(), set()))
                    spans.add((s - int(here.begins[d]), int(block.length[w])))
                    items.update(block.items[w])
                for w, d in set(zip(near_window.tolist(), here.doc_of(place).tolist())):
                    found.setdefault(d, (set(), set(), set()))[2].update(block.items[w])
                if found:
                    yield pa.RecordBatch.from_pylist(
                        [
                            {
                                "segment": segment.as_py(),
                                "nth": d,
                                "spans": [{"start": s, "length": n} for s, n in sorted(spans)],
                                "items": sorted(items),
                                "near_items": sorted(near),
                            }
                            for d, (spans, items, near) in found.items()
                        ],
                        schema=pa.schema(
                            {
                                "segment": pa.int64(),
                                "nth": pa.int32(),
                                "spans": pa.list_(pa.struct({"start": pa.int32(), "length": pa.int32()})),
                                "items": pa.list_(pa.string()),
                                "near_items": pa.list_(pa.string()),
                            }
                        ),
                    )

    return index.select("segment", "sizes", "terms", "ends", "positions").mapInArrow(search, MATCHES)


def find_phrases(index: DataFrame, windows: DataFrame, size: int = WINDOW, reach: int = NEAR) -> DataFrame:
    """``MATCHES`` of all windows: a row for each document with an exact or a proximity match.

    The windows are asked in blocks of about ``BLOCK`` (item, window) pairs. Only a
    block, never the whole set, passes the driver and is sent to the tasks.
    """
    spark = index.sparkSession
    windows = cut(windows)
    blocks = max(1, -(-windows.count() // BLOCK))
    found = []
    for number in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == number)
        pairs = [(r["item"], bytes(r["window"])) for r in own.collect()]
        if not pairs:
            continue
        phrases = Phrases(pairs, size)
        phrases.rank(_term_counts(index, send(spark, phrases)))
        found.append(_ask(index, send(spark, phrases), reach))
    if not found:
        return spark.createDataFrame([], MATCHES)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    if blocks == 1:
        return out
    merged = out.groupBy("segment", "nth").agg(
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "items", "near_items")]
    )
    return merged


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, reach: int = NEAR) -> DataFrame:
    """``doc_id, th, n_words, n_hit, n_items, items, n_near_items, spans``: a row for each row of ``docs``.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered. A
    document word inside any occurrence of an item's window is hit. ``items`` are ids
    (as strings) of items with an exact match, ``n_near_items`` counts those with a
    proximity match, ``spans`` holds start and length of the matches in words, ``th`` is
    the text's ``xxhash64``. Words
    are compared by 64-bit hash, a window therefore by all its hashes. Repeated rows
    are judged one by one, null texts have no words, and either table may be empty.
    """
    index = build_index(docs)
    found = find_phrases(index, phrase_windows(items, size), size, reach)
    rows = index.select("segment", F.posexplode(F.arrays_zip("ids", "ths", "sizes"))).select(
        "segment",
        F.col("pos").alias("nth"),
        F.col("col.ids").alias("doc_id"),
        F.col("col.ths").alias("th"),
        F.col("col.sizes").cast("long").alias("n_words"),
    )
    hit = F.expr(
        "aggregate(array_sort(spans), struct(0L AS n, 0 AS until), (a, s) -> struct("
        "a.n + greatest(0, s.start + s.length - greatest(a.until, s.start)) AS n,"
        " greatest(a.until, s.start + s.length) AS until), a -> a.n)"
    )
    return rows.join(cut(found), ["segment", "nth"], "left").select(
        "doc_id",
        "th",
        "n_words",
        F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items"),
        F.coalesce(F.size("near_items"), F.lit(0)).cast("long").alias("n_near_items"),
        "spans",
    )


def is_contaminated():
    return F.expr("n_hit > 0 AND 20 * n_hit >= n_words")

"""N-gram Jaccard join by grouped prefixes.

Shingles are ordered by counters of how often they occur. Documents whose sets agree in
size and prefix form one group; groups are paired and filtered, and only then are their
members compared by whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.llm.prefixes import links, prefix_length, pruned, shingle_sets, sieved_sets, similar_pairs
from telemap.llm.rows import components, keyed, send
from telemap.llm.words import mix, slices
from telemap.session import cut, settled

SHINGLE = 4
#: links need 100 * common >= PERCENT * all shingles
PERCENT = 85
#: counters of the order; shingles share one by hash, so its size is fixed, whatever the table
COUNTERS, PAGE = 1 << 20, 1 << 14


def occurrences(docs: DataFrame) -> np.ndarray:
    """In how many documents the shingles of each counter occur, over the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in slices(batches, "text", 2 << 20):
            hashes, _ = shingle_sets(batch.column("text"), SHINGLE)
            total += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        pages = total.reshape(-1, PAGE)
        used = np.flatnonzero(pages.any(axis=1))
        yield pa.RecordBatch.from_pydict({"page": pa.array(used.astype(np.int32)), "n": pa.array([pages[p].tobytes() for p in used], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, n in zip(batch.column("page").to_pylist(), batch.column("n").to_pylist()):
                sums[page] = sums.get(page, 0) + np.frombuffer(n, dtype=np.int64)
        yield pa.RecordBatch.from_pydict(
            {"page": pa.array(list(sums), pa.int32()), "n": pa.array([s.tobytes() for s in sums.values()], pa.binary())}
        )

    kind = "page int, n binary"
    parts = docs.select("text").mapInArrow(count, kind)
    out = np.zeros((COUNTERS // PAGE, PAGE), dtype=np.int64)
    for row in parts.repartition("page").mapInArrow(add, kind).toLocalIterator():  # COUNTERS values in all
        out[row["page"]] = np.frombuffer(row["n"], dtype=np.int64)
    return np.minimum(out.ravel(), (1 << 31) - 1).astype(np.int32)


SCANNED = "rid long, doc_id long, ord long, th long, n_shingles long, s1 long, s2 long, start long, prefix array<long>"


def scan(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """Set size, set hash, prefix and its hash of each row of a ``keyed`` table."""
    sent = send(docs.sparkSession, often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = sent()
        rid = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", 2 << 20):
            hashes, ends = shingle_sets(batch.column("text"), SHINGLE)
            sizes = np.diff(ends)
            sums = []
            for spread in (hashes, hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(spread), dtype=np.uint64)))
                sums.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((hashes, rare[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)], owner))
            length = np.where(sizes > 0, prefix_length(sizes, PERCENT), 0)
            first = np.arange(len(hashes)) - ends[owner] < length[owner]
            prefix = hashes[order][first]
            at = np.concatenate(([0], np.cumsum(length)))
            place = np.arange(len(prefix)) - np.repeat(at[:-1], length)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(prefix + place.astype(np.uint64)), dtype=np.uint64)))
            yield pa.RecordBatch.from_pydict(
                {"rid": pa.array(rid + np.arange(batch.num_rows))}
                | {c: batch.column(c) for c in ("doc_id", "ord", "th")}
                | {
                    "n_shingles": pa.array(sizes),
                    "s1": pa.array(sums[0]),
                    "s2": pa.array(sums[1]),
                    "start": pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)),
                    "prefix": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(prefix.view(np.int64))),
                }
            )
            rid += batch.num_rows

    return docs.select("doc_id", "ord", "th", "text").mapInArrow(run, SCANNED)


def ngram_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ord, th, rid, n_shingles, component, component_id``: a row for each row of ``docs``.

    A document's set holds its distinct four-word shingles (A-Z lowered); one of fewer
    words is a single shingle, one without words or text has an empty set and is linked
    with nothing. Two documents link at a similarity of ``PERCENT`` per cent.
    ``component`` names what links connect, ``component_id`` is the smallest id in it. Ids
    may repeat or be null, rows are told apart by ``rid``; a component of null ids has id
    null. Equal sets are one node; sets are told apart by 128 bits. Other columns of
    ``docs`` are ignored; an empty table gives no rows.
    """
    return settled(lambda: _ngram_groups(keyed(docs, key, text)))


def _ngram_groups(rows: DataFrame) -> DataFrame:
    scanned = cut(scan(rows, occurrences(rows)))
    filled = scanned.filter("n_shingles > 0")
    classes = cut(filled.groupBy("s1", "s2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first")))
    nodes = filled.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi")
    groups = cut(nodes.groupBy("n_shingles", "start").agg(F.min("rid").alias("group")))
    members = cut(nodes.join(groups, ["n_shingles", "start"]).select("group", F.col("rid").alias("node"), "ord", "th"))
    index = (
        nodes.join(groups.select(F.col("group").alias("rid")), "rid", "left_semi")
        .select(F.col("rid").alias("group"), F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    )
    held = cut(index.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1").select("token"))
    entries = pruned(index.join(held, "token", "left_semi"), PERCENT)

    def verify(pairs: DataFrame) -> DataFrame:
        """Only what some pair has left is fetched as a whole set."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = cut(sieved_sets(rows, cut(members.join(asked, "node", "left_semi")), SHINGLE))
        return similar_pairs(pairs, sets, PERCENT)

    edges = links(entries, members.select("group", "node"), PERCENT, verify)
    labels = components(edges)
    return in_components(scanned, classes, labels)


def in_components(scanned: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Each scanned row with the component of its class of equal sets."""
    named = labels.join(classes.select("node", "first"), "node")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    grouped = named.join(smallest, "component").select("node", "component", F.col("component_id"), F.lit(True).alias("linked"))
    full = cut(
        classes.join(grouped, "node", "left").select(
            "s1", "s2", F.coalesce("component", "node").alias("component"), F.expr("if(linked, component_id, first)").alias("component_id")
        )
    )
    out = ["doc_id", "ord", "th", "rid", "n_shingles"]
    alone = scanned.filter("n_shingles = 0").select(*out, F.col("rid").alias("component"), F.col("doc_id").alias("component_id"))
    return scanned.filter("n_shingles > 0").join(full, ["s1", "s2"]).select(*out, "component", "component_id").unionByName(alone)

"""Near-duplicate groups from SetSketch registers, with exact verification.

Register i of a document is the smallest of its shingles' exponential values under the
i-th hash, on an exponential scale of base ``BASE`` that ends at 0 and ``TOP``. Equal
bands of registers make candidates, a likelihood over both documents' registers and
sizes drops the hopeless ones, and full shingle sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.llm.ngrams import in_components
from telemap.llm.prefixes import apart, common, full_sets, links, pruned, rarest_first, shingle_sets
from telemap.llm.rows import components, keyed
from telemap.llm.words import mix, slices
from telemap.session import cut, settled

SHINGLE = 5
#: links need 100 * common >= PERCENT * all shingles
PERCENT = 75
#: 40 bands of 4 registers: a link at the limit is missed once in four million
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: a pair is dropped when its estimate lies six standard errors under the limit
MARGIN = 6 * math.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS)

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
SHIFTS = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def registers(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Register values of several sets that lie end to end; none of them is empty."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(starts)), dtype=np.uint32)
    # a few thousand values at a time stay in the cache
    bounds = np.append(starts, len(short))
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + 32768, "right")) - 1)
        part = short[bounds[low] : bounds[high]]
        at = starts[low:high] - bounds[low]
        for i in range(REGISTERS):
            least[i, low:high] = np.minimum.reduceat(part * FACTORS[i] + SHIFTS[i], at)
        low = high
    uniform = (least.T.astype(np.float64) + 0.5) / 2.0**32
    level = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / math.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint16)


def merged(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(first, second)


def band_keys(levels: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    packed = np.ascontiguousarray(levels).view(np.uint64)  # four registers of 16 bits
    return mix(packed ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def joint_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs, given registers and set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = top[:, None] * np.linspace(0, 1, 101)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    p = chance(u[:, None] - v[:, None] * grid)
    q = chance(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    total = (
        more[:, None] * np.log(np.maximum(p, tiny))
        + less[:, None] * np.log(np.maximum(q, tiny))
        + same[:, None] * np.log(np.maximum(1 - p - q, tiny))
    )
    return grid[np.arange(len(grid)), total.argmax(axis=1)]


SKETCH = "rid long, doc_id long, ord long, th long, n_shingles long, s1 long, s2 long, bands array<long>, levels binary"


def sketches(docs: DataFrame) -> DataFrame:
    """One row for each document of a ``keyed`` table: size, set hash, bands and registers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            hashes, ends = shingle_sets(batch.column("text"), SHINGLE)
            sizes = np.diff(ends)
            full = sizes > 0
            levels = registers(hashes, ends[:-1][full]) if full.any() else np.zeros((0, REGISTERS), np.uint16)
            keys = band_keys(levels).view(np.int64)
            sums = []
            for spread in (hashes, hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)):
                total = np.zeros(len(hashes) + 1, dtype=np.uint64)
                np.cumsum(mix(spread), out=total[1:])
                sums.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
            row = np.cumsum(full) - 1
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": pa.array(rid + np.arange(batch.num_rows)),
                    "doc_id": batch.column("doc_id"),
                    "ord": batch.column("ord"),
                    "th": batch.column("th"),
                    "n_shingles": pa.array(sizes),
                    "s1": pa.array(sums[0]),
                    "s2": pa.array(sums[1]),
                    "bands": pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(full) * BANDS)).astype(np.int32)), pa.array(keys.ravel())
                    ),
                    "levels": pa.array([levels[r].tobytes() if f else None for r, f in zip(row, full)], pa.binary()),
                }
            )
            rid += batch.num_rows

    return docs.select("doc_id", "ord", "th", "text").mapInArrow(sketch, SKETCH)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough, by estimate and then by full sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            la, lb = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("la", "lb")
            )
            likely = joint_estimate(la, lb, na.astype(float), nb.astype(float)) >= PERCENT / 100 - MARGIN
            keep = []
            for i in np.flatnonzero(likely).tolist():
                n, m, both = common(batch.column("xa")[i].as_py(), batch.column("xb")[i].as_py())
                if 100 * both >= PERCENT * (n + m - both):
                    keep.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})

    def side(name: str, other: str) -> DataFrame:
        return sets.select(
            F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("levels").alias(f"l{name}"), F.col("shingles").alias(f"x{name}")
        )

    full = pairs.join(side("a", "b"), "a").join(side("b", "a"), "b")
    return full.select("a", "b", "na", "nb", "la", "lb", "xa", "xb").mapInArrow(verify, "a long, b long")


def _led(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links of nodes with the leaders of their bands.

    Every node meets the one leader first that it shares most bands with; other leaders
    only where they are still in another component. So about one edge for each node
    goes into the components, however many bands it has.
    """
    met = entries.filter("node <> leader").groupBy("node", "leader", "n").agg(F.count("*").alias("bands"))
    met = met.join(sets.select(F.col("node").alias("leader"), F.col("n").alias("m")), "leader")
    near = cut(met.filter(f"100 * least(n, m) >= {PERCENT} * greatest(n, m)").select("node", "leader", "bands"))
    best = near.groupBy("node").agg(F.max_by("leader", F.struct("bands", "leader")).alias("leader"))
    edges = cut(_linked(cut(best.select(F.col("node").alias("a"), F.col("leader").alias("b"))), sets))
    others = near.select(F.col("node").alias("a"), F.col("leader").alias("b")).join(best.withColumnRenamed("node", "a"), "a")
    others = others.filter("b <> leader").select("a", "b")
    more = _linked(cut(apart(others, components(edges))), sets)
    return cut(edges.union(more))


def _beyond_leaders(entries: DataFrame, edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect all that is similar inside bands that still hold more than one component.

    The nodes of such bands are joined by prefixes that begin with the shingles that the
    fewest of them hold: what a copy has changed comes first there, and places in the
    prefixes rule out nearly all pairs of a family that are not similar.
    """
    unsettled = entries.join(components(edges), "node", "left").select("band", "node", F.coalesce("component", "node").alias("c"))
    unsettled = cut(unsettled)
    open_ = unsettled.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("band")
    nodes = cut(unsettled.join(cut(open_), "band", "left_semi").select("node").distinct())
    if not nodes.limit(1).count():
        return edges
    index = pruned(rarest_first(sets, nodes, PERCENT), PERCENT)
    members = nodes.select(F.col("node").alias("group"), "node")
    return links(index, members, PERCENT, lambda pairs: _linked(pairs, sets), edges)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ord, th, rid, n_shingles, component, component_id``: a row for each row of ``docs``.

    A document's set holds its distinct five-word shingles (A-Z lowered); one of fewer
    words is a single shingle, one without words or text has an empty set and is linked
    with nothing. Documents of equal sets are one node. The nodes of a band are compared
    with the one of them that shares most bands; where bands then still hold more than one component, their
    nodes are joined by prefixes. No link between nodes of a band is left out.
    ``component_id`` is the smallest id reachable; ids may repeat or be null, the rows are
    then told apart by ``rid``, and a component of null ids has id null. Other columns of
    ``docs`` are ignored; an empty table gives no rows.
    """
    return settled(lambda: _near_duplicates(keyed(docs, key, text)))


def _near_duplicates(rows: DataFrame) -> DataFrame:
    sketched = cut(sketches(rows))
    filled = sketched.filter("n_shingles > 0")
    classes = cut(filled.groupBy("s1", "s2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first")))

    nodes = filled.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi")
    entries = nodes.select(F.explode("bands").alias("band"), F.col("rid").alias("node"), F.col("n_shingles").alias("n"))
    shared = entries.groupBy("band").agg(F.count("*").alias("many")).filter("many > 1").select("band")
    met = cut(entries.join(cut(shared), "band", "left_semi"))
    # what most bands of a family have in common is the text that its members were made from
    often = met.groupBy("node").agg(F.count("*").alias("bands"))
    lead = met.join(often, "node").groupBy("band").agg(F.max(F.struct("bands", (-F.col("node")).alias("last")))["last"].alias("last"))
    entries = cut(met.join(lead.select("band", (-F.col("last")).alias("leader")), "band"))
    known = entries.select("node").distinct()
    wanted = filled.select(F.col("rid").alias("node"), "ord", "th", "levels").join(known, "node", "left_semi")
    sets = cut(full_sets(rows, wanted, SHINGLE, "levels"))
    edges = _beyond_leaders(entries, _led(entries, sets), sets)
    return in_components(sketched, classes, components(edges))

"""Exact links between sets by prefixes of a global order, without all pairs of a group.

Two sets that are similar share one of their first tokens in any order that holds for all
of them. A list of the prefix index is compared with one leader; what is then still in
different components is compared pair by pair, unless sizes and places rule a pair out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.llm.rows import components, send
from telemap.llm.words import FOLDED, Runs, shingle_starts, slices, words
from telemap.session import cut, forget


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each set starts."""
    found = words(column, FOLDED)
    start, length, counts = shingle_starts(found, size)
    hashes = Runs(found.hashes).of(start, length) if len(start) else np.zeros(0, np.uint64)
    ends = np.concatenate(([0], np.cumsum(counts)))
    sets = [np.unique(hashes[ends[i] : ends[i + 1]]) for i in range(len(counts))]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def prefix_length(n, percent: int):
    """First tokens of which two similar sets share at least one."""
    return n - -(-percent * n // 100) + 1


def full_sets(docs: DataFrame, nodes: DataFrame, size: int, *carry: str) -> DataFrame:
    """``node, n, shingles`` (packed, sorted) and carried columns of ``nodes`` (node, ord, th)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a row meet in one task; one of them is enough
        for batch in slices(batches, "text"):
            node = batch.column("node").to_pylist()
            new = [i for i, x in enumerate(node) if x not in seen and not seen.add(x)]
            batch = batch.take(pa.array(new, pa.int64()))
            hashes, ends = shingle_sets(batch.column("text"), size)
            packed = [hashes[ends[i] : ends[i + 1]].tobytes() for i in range(len(ends) - 1)]
            yield pa.RecordBatch.from_pydict(
                {"node": batch.column("node"), "n": pa.array(np.diff(ends)), "shingles": pa.array(packed, pa.binary())}
                | {c: batch.column(c) for c in carry}
            )

    joined = docs.select("ord", "th", "text").join(nodes, ["ord", "th"]).select("node", *carry, "text")
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in carry)
    return joined.mapInArrow(gather, f"node long, n long, shingles binary{kinds}")


#: bits of the filter that keeps rows of no candidate out of the shuffle; its size is fixed
SIEVE = 1 << 23


def sieved_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """As ``full_sets``; sets are taken where texts are read, and only likely ones are shuffled.

    A bit for each hash of a wanted row, of fixed number, goes to the tasks; what passes by
    chance goes in the join with ``nodes``.
    """
    place = F.pmod(F.xxhash64("ord", "th"), F.lit(SIEVE))
    marks = nodes.select(place.alias("h")).groupBy(F.shiftright("h", 15).alias("page")).agg(F.expr("bitmap_construct_agg(h & 32767)").alias("bits"))
    pages = np.zeros((SIEVE >> 15, 4096), dtype=np.uint8)
    for row in marks.collect():  # at most SIEVE / 32768 rows
        pages[row["page"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    sent = send(docs.sparkSession, pages.ravel())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent()
        for batch in slices(batches, "text", 2 << 20):
            h = batch.column("h").to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(bits[h >> 3] >> (h & 7).astype(np.uint8) & 1)))
            hashes, ends = shingle_sets(batch.column("text"), size)
            packed = [hashes[ends[i] : ends[i + 1]].tobytes() for i in range(len(ends) - 1)]
            yield pa.RecordBatch.from_pydict(
                {"ord": batch.column("ord"), "th": batch.column("th"), "n": pa.array(np.diff(ends)), "shingles": pa.array(packed, pa.binary())}
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a row meet in one task; one of them is enough
        for batch in slices(batches, "shingles", 2 << 20):
            node = batch.column("node").to_pylist()
            yield batch.take(pa.array([i for i, x in enumerate(node) if x not in seen and not seen.add(x)], pa.int64()))

    likely = docs.select("ord", "th", "text", place.alias("h")).mapInArrow(gather, "ord long, th long, n long, shingles binary")
    joined = likely.join(nodes.select("node", "ord", "th"), ["ord", "th"]).select("node", "n", "shingles")
    return joined.mapInArrow(once, "node long, n long, shingles binary")


def common(a: bytes, b: bytes) -> tuple[int, int, int]:
    """Sizes of two packed sorted sets and of their intersection."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) > len(y):
        x, y = y, x
    return len(x), len(y), int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * common >= percent * all of their sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "xa", 2 << 20):
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("xa"), batch.column("xb"))):  # one pair at a time
                n, m, both = common(a.as_buffer(), b.as_buffer())
                if 100 * both >= percent * (n + m - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b"
    )
    return full.select("a", "b", "xa", "xb").mapInArrow(verify, "a long, b long")


def rarest_first(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``token, group, n, pos``: prefixes of some of ``sets``, ordered by how few of those hold a token.

    Tokens of one set alone come first in that order and are in no list.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a set at a time
                own = np.frombuffer(batch.column("shingles")[i].as_py(), dtype=np.int64)
                node = np.full(len(own), batch.column("node")[i].as_py())
                yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "token": pa.array(own)})

    chosen = sets.join(nodes.select("node"), "node", "left_semi")
    tokens = chosen.select("node", "shingles").mapInArrow(spread, "node long, token long")
    held = cut(tokens.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1"))
    own = tokens.join(held, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("many", "token"))).alias("own"))
    sized = own.join(sets.select("node", F.col("n").cast("long").alias("n")), "node").withColumn("alone", F.expr("n - size(own)"))
    first = F.expr(f"slice(own, 1, cast(greatest(0, n - ceil({percent} * n / 100) + 1 - alone) as int))")
    listed = sized.select("node", "n", "alone", F.posexplode(first).alias("at", "t"))
    return listed.select("t.token", F.col("node").alias("group"), "n", (F.col("alone") + F.col("at")).alias("pos"))


def _fits(percent: int) -> str:
    """Whether sets of n and m tokens that first meet at places pos and at can be similar."""
    return (
        f"100 * least(n, m) >= {percent} * greatest(n, m) AND "
        f"{100 + percent} * least(n - pos, m - at) >= {percent} * (n + m)"
    )


def pruned(entries: DataFrame, percent: int) -> DataFrame:
    """Entries that can still find a partner in their list, by the sizes that are in it.

    Twice, since what the first pass takes out may have been another's only partner.
    """
    first = cut(_pruned(entries, percent))
    out = cut(_pruned(first, percent))
    forget(first)
    return out


def _pruned(entries: DataFrame, percent: int) -> DataFrame:
    reach = F.expr(f"{100 + percent} * (n - pos) div {percent} - n")  # the largest partner that the place leaves
    sized = entries.withColumn("reach", reach).filter(f"100 * reach >= {percent} * n")
    lists = sized.groupBy("token").agg(F.count("*").alias("many"), F.min("n").alias("least"), F.max("reach").alias("most"))
    kept = sized.join(lists.filter("many > 1"), "token").filter("reach >= least AND n <= most")
    return kept.select("token", "group", "n", "pos")


def links(
    index: DataFrame,
    members: DataFrame,
    percent: int,
    verify: Callable[[DataFrame], DataFrame],
    known: DataFrame | None = None,
) -> DataFrame:
    """``a, b``: links of nodes that connect all that are similar; ``known`` links come with them.

    ``index`` (token, group, n, pos), ``pruned``, is the prefix index of groups of nodes that
    agree in size and prefix, ``members`` (group, node) says who they are. ``verify`` keeps the
    pairs (a, b) of nodes that are similar.
    """
    heads = cut(members.groupBy("group").agg(F.min("node").alias("head")))
    lead = index.groupBy("token").agg(F.min(F.struct("pos", "group", "n")).alias("l"))
    lead = lead.select("token", F.col("l.pos").alias("at"), F.col("l.group").alias("lead"), F.col("l.n").alias("m"))
    met = index.join(lead, "token").filter("group <> lead").filter(_fits(percent)).select("group", "lead").distinct()
    across = met.join(members, "group").select("node", "lead").join(heads.withColumnRenamed("group", "lead"), "lead")
    inside = members.join(heads, "group").filter("node <> head")
    pairs = across.select(F.col("node").alias("a"), F.col("head").alias("b")).union(inside.select("node", "head"))
    if known is not None:
        pairs = apart(pairs, components(known))
    tested = cut(pairs)
    edges = cut(verify(tested) if known is None else verify(tested).union(known))

    labels = components(edges)
    named = members.join(labels, "node", "left").select("group", "node", F.coalesce("component", "node").alias("c"))
    named = cut(named)
    groups = cut(named.groupBy("group").agg(F.min("c").alias("c"), F.max("c").alias("d")))
    split = index.join(groups, "group")
    open_ = split.groupBy("token").agg(F.min("c").alias("low"), F.max("d").alias("high")).filter("low < high").select("token")
    split = cut(split.join(cut(open_), "token", "left_semi"))
    most = split.groupBy("token", "c").agg(F.count("*").alias("many")).groupBy("token").agg(F.max_by("c", "many").alias("main"))
    split = cut(split.join(cut(most), "token").withColumn("main", F.expr("c = d AND c = main")))
    other = split.select("token", *[F.col(x).alias(y) for x, y in (("group", "group_"), ("n", "m"), ("pos", "at"), ("c", "c_"), ("d", "d_"), ("main", "main_"))])
    # a pair of different components has one that is not in the list's main one
    wide = (
        split.filter("NOT main")
        .join(other, "token")
        .filter("group <> group_ AND (main_ OR group < group_) AND NOT (c = d AND c = c_ AND c = d_)")
        .filter(_fits(percent))
        .select("group", "group_")
        .distinct()
    )
    torn = groups.filter("c < d").select("group", F.col("group").alias("group_"))
    two = named.select(F.col("group").alias("group_"), F.col("node").alias("node_"), F.col("c").alias("c_"))
    rest = cut(wide.union(torn)).join(named, "group").join(two, "group_").filter("c <> c_ AND (group <> group_ OR node < node_)")
    both = rest.select(F.greatest("node", "node_").alias("a"), F.least("node", "node_").alias("b")).distinct()
    known_pairs = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = verify(cut(both.join(known_pairs, ["a", "b"], "left_anti")))
    return cut(edges.union(more))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) whose nodes are in different components."""
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return both.filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

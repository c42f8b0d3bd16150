"""Line dedup: an exact set-similarity join of lines with prefix, position and length filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.llm.rows import in_ranges, keyed, send
from telemap.llm.words import FOLDED, mix, slices, words
from telemap.session import cut, forget, settled

#: lines are copies when 100 * common >= PERCENT * all words of both
PERCENT = 75
#: counters of the rarity table; words share one by hash, so its size is fixed
COUNTERS = 1 << 18
#: bits of the filter that lines pass before their words are shuffled; its size is fixed
SIEVE = 1 << 23
#: the index is built for so many slices of the tokens, one after the other, and for fewer where a slice would hold less than SLICE_SETS sets
SLICES, SLICE_SETS = 2, 50_000
#: entries of the index that a task holds at once, about, and pairs it looks at at once
BIN, CHUNK = 200_000, 1 << 20
#: a list of more than LONG entries is first compared with its LEADERS earliest sets
LONG, LEADERS = 1 << 14, 256
#: a set that meets up to FEW earlier sets in a bin is compared with all of them at once, others with the likeliest first
FEW = 4
#: counters that travel as one record
PAGE = 4096


def split_lines(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of a batch of texts, end to end, and where those of each text begin."""
    parts = pc.split_pattern(column.cast(pa.large_string()).fill_null(""), "\n")
    ends = np.concatenate(([0], np.cumsum(parts.value_lengths().to_numpy()))).astype(np.int64)
    return parts.flatten(), ends


def line_sets(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word hashes of each line, end to end, and where each set begins."""
    found = words(lines, FOLDED)
    owner = found.owner()
    order = _by_owner(owner, found.hashes)
    owner, hashes = owner[order], found.hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.searchsorted(owner, np.arange(len(lines) + 1))


def _by_owner(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Order by owner, then hash: one sort of both packed into a word, unless its bits do not tell two hashes apart."""
    bits = int(owner[-1]).bit_length() if len(owner) else 0
    key = hashes >> np.uint64(bits)
    if bits:
        key |= owner.astype(np.uint64) << np.uint64(64 - bits)
    order = np.argsort(key)
    key, sorted_ = key[order], hashes[order]
    if ((key[1:] == key[:-1]) & (sorted_[1:] < sorted_[:-1])).any():
        return np.lexsort((hashes, owner))
    return order


def _by_rank(owner: np.ndarray, nth: np.ndarray, rank: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Order by owner, then rank, then place ``nth`` in the owner's run: one sort of the three packed into a word."""
    few, many = (int(x.max()).bit_length() if len(x) else 0 for x in (nth, rank))
    if few + many + (int(owner[-1]).bit_length() if len(owner) else 0) > 63:
        return np.lexsort((nth, rank, owner))
    key = np.sort((owner << (few + many)) | (rank.astype(np.int64) << few) | nth)
    return begin[key >> (few + many)] + (key & ((1 << few) - 1))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Rarest words of which two copies share at least one."""
    return n - -(-PERCENT * n // 100) + 1


def rarity(docs: DataFrame) -> np.ndarray:
    """How often each counter's words occur in the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in slices(batches, 0):
            found = words(batch.column(0), FOLDED).hashes
            total += np.bincount((found & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        pages = total.reshape(-1, PAGE)
        used = np.flatnonzero(pages.any(axis=1))
        yield pa.RecordBatch.from_pydict({"page": pa.array(used.astype(np.int32)), "n": pa.array([pages[i].tobytes() for i in used], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most COUNTERS / PAGE
        for batch in batches:
            for page, n in zip(batch.column("page").to_pylist(), batch.column("n")):
                sums[page] = sums.get(page, 0) + np.frombuffer(n.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"page": pa.array(list(sums), pa.int32()), "n": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    counted = docs.select("text").mapInArrow(count, "page int, n binary")
    out = np.zeros((COUNTERS // PAGE, PAGE), dtype=np.int64)
    for row in counted.repartition("page").mapInArrow(add, "page int, n binary").toLocalIterator():  # at most COUNTERS / PAGE rows
        out[row["page"]] = np.frombuffer(row["n"], dtype=np.int64)
    return out.ravel()


def parities(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, bit i set where an odd number of its words have i as their top bits.

    Sets that differ in k words differ in at most k of these bits.
    """
    place = hashes >> np.uint64(57)
    bit = np.uint64(1) << (place & np.uint64(63))
    out = []
    for lane in (0, 1):
        mine = np.where((place >> np.uint64(6)) == np.uint64(lane), bit, np.uint64(0))
        run = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(mine)))
        out.append((run[begin[1:]] ^ run[begin[:-1]]).view(np.int64))
    return out[0], out[1]


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit values of all rows, end to end, and how many each row has."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return np.frombuffer(values.tobytes(), dtype=np.uint64), np.diff(ends) >> 3


def _packed(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Runs of 64-bit values as binary."""
    buffers = [None, pa.py_buffer((begin * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, buffers)


SCANNED = "doc_id long, ord long, th long, lines array<struct<line:int,s:long,n:int,low:long,high:long,prefix:binary>>"


def scan(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """For each row of a ``keyed`` table its lines with words: number, set hash, set size, rarest words.

    The rarest words come packed, in order of rarity, ties by hash. Of a set's places in a slice
    only the first by id, line and text hash has its words, in whatever order rows are read.
    """
    sent = send(docs.sparkSession, np.unique(often, return_inverse=True)[1])
    kind = pa.list_(
        pa.struct({"line": pa.int32(), "s": pa.int64(), "n": pa.int32(), "low": pa.int64(), "high": pa.int64(), "prefix": pa.binary()})
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = sent()
        for batch in slices(batches, "text"):
            lines, ends = split_lines(batch.column("text"))
            hashes, begin = line_sets(lines)
            n = np.diff(begin)
            sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(mix(hashes ^ np.uint64(0x5DEECE66D1234567)), out=sums[1:])
            sets = mix(sums[begin[1:]] - sums[begin[:-1]] + n.astype(np.uint64))
            owner = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(hashes)) - begin[owner]  # the hashes of a line are sorted
            order = _by_rank(owner, nth, rare[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)], begin)
            used = np.flatnonzero(n)  # lines with words
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[used]
            number = used - ends[row]
            ids, texts = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("ord", "th"))
            placed = np.lexsort((texts, number, ids, sets[used]))  # the order of a class's first place
            first = np.ones(len(used), dtype=bool)
            first[1:] = sets[used][placed][1:] != sets[used][placed][:-1]
            fresh = np.zeros(len(n), dtype=bool)
            fresh[used[placed[first]]] = True
            keep = (nth < prefix_length(n)[owner]) & fresh[owner]
            many = np.bincount(owner[keep], minlength=len(n))[used]
            prefix = _packed(hashes[order][keep], np.concatenate(([0], np.cumsum(many))))
            low, high = parities(hashes, begin)
            entries = pa.StructArray.from_arrays(
                [pa.array(number.astype(np.int32)), pa.array(sets[used].view(np.int64)), pa.array(n[used].astype(np.int32))]
                + [pa.array(low[used]), pa.array(high[used]), prefix],
                fields=list(kind.value_type),
            )
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("doc_id", "ord", "th")}
                | {"lines": pa.ListArray.from_arrays(pa.array(np.searchsorted(used, ends).astype(np.int32)), entries).cast(kind)}
            )

    return docs.select("doc_id", "ord", "th", "text").mapInArrow(run, SCANNED)


def _sieve(ord_: np.ndarray, th: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The bit of a line in a filter of ``SIEVE`` bits."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    place = mix(ord_.astype(np.int64).view(np.uint64) + line.astype(np.uint64) * odd)
    return (mix(place ^ th.astype(np.int64).view(np.uint64)) & np.uint64(SIEVE - 1)).astype(np.int64)


def _bits(marks: DataFrame) -> np.ndarray:
    """``SIEVE`` bits, packed, those set that ``marks`` (h) has."""
    paged = marks.groupBy(F.shiftright("h", 15).alias("page")).agg(F.expr("bitmap_construct_agg(h & 32767)").alias("bits"))
    pages = np.zeros((SIEVE >> 15, 4096), dtype=np.uint8)
    for found in paged.collect():  # at most SIEVE / 32768 rows
        pages[found["page"]] = np.frombuffer(found["bits"], dtype=np.uint8)
    return pages.ravel()


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cid, words`` (packed, sorted) of the lines in ``wanted`` (ord, th, line, cid).

    Words are taken where texts are read, of the lines that pass a filter of fixed size;
    what passes it by chance goes in the join with ``wanted``.
    """

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": pa.array(_sieve(*(c.to_numpy() for c in batch.columns)))})

    sent = send(docs.sparkSession, _bits(wanted.select("ord", "th", "line").mapInArrow(bits_of, "h long")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent()
        for batch in slices(batches, "text"):
            lines, ends = split_lines(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            number = np.arange(len(row)) - ends[row]
            ids, texts = (batch.column(c).to_numpy()[row] for c in ("ord", "th"))
            h = _sieve(ids, texts, number)
            likely = np.flatnonzero(bits[h >> 3] >> (h & 7).astype(np.uint8) & 1)
            hashes, begin = line_sets(lines.take(pa.array(likely)))
            sets = [hashes[begin[i] : begin[i + 1]].tobytes() for i in range(len(likely))]
            yield pa.RecordBatch.from_pydict(
                {"ord": pa.array(ids[likely]), "th": pa.array(texts[likely])}
                | {"line": pa.array(number[likely].astype(np.int32)), "words": pa.array(sets, pa.binary())}
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a row meet in one task; one of them is enough
        for batch in batches:
            cid = batch.column("cid").to_pylist()
            yield batch.take(pa.array([i for i, x in enumerate(cid) if x not in seen and not seen.add(x)], pa.int64()))

    likely = docs.select("ord", "th", "text").mapInArrow(gather, "ord long, th long, line int, words binary")
    joined = likely.join(wanted.select("ord", "th", "line", "cid"), ["ord", "th", "line"]).select("cid", "words")
    return joined.mapInArrow(once, "cid long, words binary")


def _copies(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (late, early) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * common >= PERCENT * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select(["late", "early"]).take(pa.array(keep, pa.int64()))

    full = pairs.join(sets.select(F.col("cid").alias("late"), F.col("words").alias("a")), "late").join(
        sets.select(F.col("cid").alias("early"), F.col("words").alias("b")), "early"
    )
    return full.select("late", "early", "a", "b").mapInArrow(run, "late long, early long")


ENTRY = {"token": np.uint64, "cid": np.int64, "low": np.uint64, "high": np.uint64, "n": np.int32, "pos": np.int32, "asked": np.bool_}
BINNED = ", ".join(["bin int", *(f"{c} binary" for c in ENTRY)])


def _dealt(sets: DataFrame, parts: int, part: int, bins: int, tokens=None) -> DataFrame:
    """Entries of the prefix index of ``sets`` (cid, n, low, high, prefix, asked) in one slice, packed by ``bin``.

    ``tokens`` are the bits of a filter that their tokens pass.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = tokens() if tokens else None
        for batch in slices(batches, "prefix", 2 << 20):
            own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "low", "high", "n", "asked")}
            token, size = _unpacked(batch.column("prefix"))
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            keep = token % np.uint64(parts) == np.uint64(part)
            if bits is not None:
                h = (token & np.uint64(SIEVE - 1)).astype(np.int64)
                keep &= (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
            keep = np.flatnonzero(keep)
            bin_ = (token[keep] // np.uint64(parts) % np.uint64(bins)).astype(np.int32)
            order = np.argsort(bin_, kind="stable")
            keep, bin_ = keep[order], bin_[order]
            first = np.flatnonzero(np.diff(bin_, prepend=-1))
            ends = np.append(first, len(bin_))
            values = {"token": token[keep], "pos": pos[keep]} | {c: x[row[keep]] for c, x in own.items()}
            values = {c: values[c].view(t) if np.dtype(t) == np.uint64 else values[c].astype(t) for c, t in ENTRY.items()}
            yield pa.RecordBatch.from_pydict(
                {"bin": pa.array(bin_[first])}
                | {c: pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary()) for c, x in values.items()}
            )

    return sets.select("cid", "n", "low", "high", "prefix", "asked").mapInArrow(spread, BINNED)


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Entries of one bin after the other, from rows in the order of bins."""
    held, now = [], None
    for batch in chain(batches, [None]):
        if batch is None or batch.num_rows:
            bins = [None] if batch is None else batch.column("bin").to_pylist()
            for i, bin_ in enumerate(bins):
                if bin_ != now and held:
                    yield {c: np.frombuffer(b"".join(h[c] for h in held), dtype=t) for c, t in ENTRY.items()}
                    held = []
                now = bin_
                if batch is not None:
                    held.append({c: batch.column(c)[i].as_py() for c in ENTRY})


class _Lists:
    """Entries of a bin in the order of their lists and, inside one, of the sizes of their sets."""

    def __init__(self, entries: dict[str, np.ndarray], asked_only: bool) -> None:
        order = np.lexsort((entries["n"], entries["token"]))
        token = entries["token"][order]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(start, len(token)))
        use = size > 1
        if asked_only:
            use &= np.add.reduceat(entries["asked"][order].astype(np.int64), start) > 0
        order = order[np.repeat(use, size)]
        self.size = size[use]
        self.start = np.cumsum(self.size) - self.size
        self.cid, self.low, self.high, self.asked = (entries[c][order] for c in ("cid", "low", "high", "asked"))
        self.n, pos = entries["n"][order].astype(np.int64), entries["pos"][order]
        #: the largest partner that a place leaves: (100 + PERCENT) * (n - pos) >= PERCENT * (n + m)
        self.reach = (100 + PERCENT) * (self.n - pos) // PERCENT - self.n
        self.asked_only = asked_only

    def fitting(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """``late, early, differ`` of those places that can be similar, which differ in so many bits at least."""
        n, m = self.n[i], self.n[j]
        fit = (self.reach[i] >= m) & (self.reach[j] >= n) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        if self.asked_only:
            fit &= np.where(self.cid[i] > self.cid[j], self.asked[i], self.asked[j])
        i, j, n = i[fit], j[fit], (n + m)[fit]
        differ = np.bitwise_count(self.low[i] ^ self.low[j]).astype(np.int64) + np.bitwise_count(self.high[i] ^ self.high[j])
        fit = ((100 + PERCENT) * differ <= (100 - PERCENT) * n) & (self.cid[i] != self.cid[j])
        a, b = self.cid[i[fit]], self.cid[j[fit]]
        return np.maximum(a, b), np.minimum(a, b), differ[fit]

    def pairs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """``fitting`` of all pairs in lists of up to LONG entries: each with the smaller sets that its place leaves."""
        r = np.repeat(np.arange(len(self.size)), self.size)
        wide = int(self.n.max(initial=0)) + 2
        key = r * wide + self.n
        low = np.searchsorted(key, r * wide + -(-PERCENT * self.n // 100), "left")
        high = np.searchsorted(key, r * wide + np.clip(self.reach, -1, self.n), "right")
        many = np.maximum(np.minimum(high, np.arange(len(r))) - low, 0)
        many[np.repeat(self.size > LONG, self.size)] = 0
        ends, at = np.cumsum(many), 0
        while at < len(many):
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")), at + 1)
            mine = many[at:to]
            i = np.repeat(np.arange(at, to), mine)
            yield self.fitting(i, np.arange(len(i)) - np.repeat(np.cumsum(mine) - mine - low[at:to], mine))
            at = to

    def long_pairs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """``fitting`` of longer lists: all with the earliest sets, or with those that are asked for."""
        for k in np.flatnonzero(self.size > LONG):
            every = np.arange(self.start[k], self.start[k] + self.size[k])
            if self.asked_only:
                chosen = every[self.asked[every]]
            else:
                chosen = every[np.argpartition(self.cid[every], LEADERS)[:LEADERS]]
            for one in chosen:
                for part in range(0, len(every), CHUNK):
                    other = every[part : part + CHUNK]
                    yield self.fitting(np.full(len(other), one), other)

    def unmet(self) -> np.ndarray:
        """Sets in longer lists, which have not met all of them."""
        return np.unique(self.cid[np.repeat(self.size > LONG, self.size)])


def _best(late: np.ndarray, early: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the FEW + 1 different pairs of each later set that differ least, and which of them are its first."""
    order = np.lexsort((early, differ, late))
    new = np.append(True, (np.diff(late[order]) != 0) | (np.diff(early[order]) != 0))[: len(order)]
    order = order[new]
    first = np.append(True, np.diff(late[order]) != 0)[: len(order)]
    start = np.flatnonzero(first)
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[nth <= FEW], first[nth <= FEW]


def _likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``late, early, more``: earlier sets that a set meets in a bin; of more than FEW the likeliest, and that there are more."""
    for entries in _bins(batches):
        lists = _Lists(entries, False)
        held, n = [(np.zeros(0, np.int64),) * 3], 0
        for found in chain(lists.pairs(), lists.long_pairs()):
            held.append(found)
            n += len(found[0])
            if n > CHUNK:
                held = [tuple(np.concatenate(x) for x in zip(*held))]
                order, _ = _best(*held[0])
                held, n = [tuple(x[order] for x in held[0])], 0
        late, early, differ = (np.concatenate(x) for x in zip(*held))
        order, first = _best(late, early, differ)
        late, early = late[order], early[order]
        start, unmet = np.flatnonzero(first), lists.unmet()
        many = np.diff(np.append(start, len(late)))
        more = np.repeat(many > FEW, many) | np.isin(late, unmet)
        keep = first | ~more
        alone = np.setdiff1d(unmet, late)
        yield pa.RecordBatch.from_pydict(
            {
                "late": pa.array(np.concatenate((late[keep], alone))),
                "early": pa.array(np.concatenate((early[keep], np.full(len(alone), -1)))),
                "more": pa.array(np.concatenate((more[keep], np.ones(len(alone), dtype=bool)))),
            }
        )


def _all_fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``late, early``: all pairs of a bin whose later set is asked for."""
    for entries in _bins(batches):
        lists = _Lists(entries, True)
        seen = np.zeros((0, 2), dtype=np.int64)
        for late, early, _ in chain(lists.pairs(), lists.long_pairs()):
            seen = np.concatenate((seen, np.stack((late, early), axis=1)))
            if len(seen) > CHUNK:
                yield _two(seen)
                seen = seen[:0]
        yield _two(seen)


def _two(pairs: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(pairs, axis=0)
    return pa.RecordBatch.from_pydict({"late": pa.array(np.ascontiguousarray(pairs[:, 0])), "early": pa.array(np.ascontiguousarray(pairs[:, 1]))})


def _resolve(rows: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``cid`` of every set that is a copy of an earlier one.

    The prefixes of ``sets`` (cid, n, low, high, prefix) make an index with a list for each
    token, dealt in bins of tokens. A set that meets few earlier sets in a bin is compared with
    them, others with the likeliest one, so that a group of copies costs a few lines for each
    set. Only sets that this does not settle, and that met more, are compared with all that the
    filters leave; the index then has the lists of their tokens alone. It is built for one slice of
    the tokens at a time, so that a part of it is all that is shuffled at once.
    """
    spark = sets.sparkSession
    all_, many = sets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)) / 8).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def meet(of: DataFrame, asked: int, how, schema: str, tokens=None) -> DataFrame:
        parts = max(1, min(SLICES, asked // SLICE_SETS))
        bins = max(4 * tasks, int(many / parts / BIN))
        met = [
            cut(_dealt(of, parts, part, bins, tokens).repartition(tasks, "bin").sortWithinPartitions("bin").mapInArrow(how, schema))
            for part in range(parts)
        ]
        out = cut(reduce(DataFrame.union, met).distinct())
        forget(*met)
        return out

    def settle(pairs: DataFrame) -> DataFrame:
        """Later sets that are copies of the earlier set of one of their pairs."""
        asked = pairs.select(F.col("late").alias("cid")).union(pairs.select("early")).distinct()
        wanted = cut(classes.join(asked, "cid", "left_semi").select("ord", "th", "line", "cid"))
        full = cut(_sets_of(rows, wanted))
        found = cut(_copies(pairs, full).select(F.col("late").alias("cid")).distinct())
        forget(full, wanted)
        return found

    first = meet(sets.withColumn("asked", F.lit(False)), all_, _likeliest, "late long, early long, more boolean")
    done = settle(first.filter("early >= 0").select("late", "early").distinct())
    left = cut(first.filter("more").select(F.col("late").alias("cid")).distinct().join(done, "cid", "left_anti"))
    forget(first)
    n_left = left.count()
    if not n_left:
        return done

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, _ = _unpacked(batch.column(0))
            yield pa.RecordBatch.from_pydict({"h": pa.array((token & np.uint64(SIEVE - 1)).astype(np.int64))})

    own = cut(sets.join(left, "cid", "left_semi").withColumn("asked", F.lit(True)))
    tokens = send(spark, _bits(own.select("prefix").mapInArrow(marks, "h long")))
    open_ = sets.withColumn("asked", F.lit(False)).union(own)
    rest = meet(open_, n_left, _all_fitting, "late long, early long", tokens)
    more = settle(rest)
    forget(rest, left, own)
    return cut(done.union(more))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ord, th, n_lines, removed_lines``: a row for each row of ``docs``.

    Lines end at a line feed; lines with a word count, and a line's set holds its
    different words (runs of other than white space, A-Z lowered). A line is removed
    when an earlier line, by id and then by place, has a set of which both share
    ``PERCENT`` per cent; lines are judged on the input. ``removed_lines`` has their
    numbers in the text, from 0. Rows without an id come last, rows that share an id do
    not affect each other at equal places. Null and empty texts have no lines. Sets
    are told apart by 64-bit hashes and compared by the hashes of their words. Other
    columns of ``docs`` are ignored; an empty table gives no rows.
    """
    return settled(lambda: _repeated_lines(keyed(docs, key, text)))


def _repeated_lines(rows: DataFrame) -> DataFrame:
    scanned = cut(scan(rows, rarity(rows)))
    lines = scanned.select("ord", "th", F.explode("lines").alias("l")).select("ord", "th", "l.*")
    # a slice gives a set's words at its first place there, so the first place of all always has them
    own = F.struct("ord", "line", "th", "n", "low", "high", "prefix")
    firsts = cut(lines.filter("octet_length(prefix) > 0").groupBy("s").agg(F.min(own).alias("f")).select("s", "f.*"))
    places = cut(scanned.select("doc_id", "ord", "th", F.expr("transform(lines, l -> struct(l.line, l.s))").alias("lines")))
    forget(scanned)
    ranged = in_ranges(firsts, F.col("ord"), F.col("line"), F.col("s"))
    forget(firsts)
    numbered = ranged.select("row.*", F.col("nth").alias("cid"))  # in the order of the ranges
    classes, sets = numbered.select("s", "ord", "line", "th", "cid"), numbered.select("cid", "n", "low", "high", "prefix")
    lines = places.select("ord", "th", F.explode("lines").alias("l")).select("ord", "th", "l.*")
    late = _resolve(rows, sets, classes)
    # every occurrence but the first goes, and the first where an earlier set is similar
    marked = cut(
        classes.select("s", F.col("ord").alias("o"), F.col("line").alias("l"), "cid").join(
            late.withColumn("late", F.lit(True)), "cid", "left"
        )
    )
    forget(ranged)
    gone = (
        lines.select("s", "ord", "th", "line")
        .join(marked, "s")
        .filter("late OR struct(ord, line) > struct(o, l)")
        .groupBy("ord", "th")
        .agg(F.array_sort(F.collect_set("line")).alias("removed_lines"))
    )
    return places.select("doc_id", "ord", "th", F.size("lines").cast("long").alias("n_lines")).join(
        gone, ["ord", "th"], "left"
    ).withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))


def without_lines(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text``: the documents without the lines that ``repeated_lines`` found in them; a null text stays null."""
    gone = found.select("ord", "th", "removed_lines").distinct()
    left = "array_join(filter(split(text, '\\n', -1), (x, i) -> NOT array_contains(removed_lines, i)), '\\n')"
    return keyed(docs, key, text).join(gone, ["ord", "th"], "left").select("doc_id", F.expr(left).alias("text"))

"""Words and their hashes for whole Arrow batches of texts, in NumPy.

A batch is cut into pieces of about ``PIECE`` bytes that end between two words, so
memory does not follow the longest text. A word's hash is a polynomial over the
ring of 64-bit integers, taken from a prefix sum; the hash of any run of words is
taken from a second prefix sum over the word hashes. Both are the same on every
machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C17 | 3)  # odd, 3 modulo 4
RUN_BASES = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD97 | 3))


def _table(drop: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and the 64-bit value of each byte."""
    inside = np.ones(256, dtype=bool)
    inside[list(drop)] = False
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
    if lower:
        value[65:91] = value[97:123]
    return inside, value


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


SPACES = b" \t\n\x0b\x0c\r"
BREAKS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(65, 91))
#: words between white space, as written; the same with A-Z lowered; lowered letters and digits only
PLAIN = _table(SPACES, False)
FOLDED = _table(SPACES, True)
LETTERS = _table(bytes(set(BREAKS) - set(_UPPER)), True)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of ``base`` and of its inverse modulo 2**64."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) <= n:
        inverse = np.uint64(pow(key, -1, 1 << 64))
        size = max(n + 1, PIECE + 65536)
        both = []
        for b in (base, inverse):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers[key] = both[0], both[1]
    return _powers[key]


def slices(batches: Iterator[pa.RecordBatch], column: int | str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, of about ``size`` bytes of text but a row at least."""
    for batch in batches:
        text = batch.column(column).cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of some texts: ``hashes`` of all, ``ends[i]:ends[i + 1]`` those of text i."""

    hashes: np.ndarray
    ends: np.ndarray
    stems: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ends) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.ends[i] : self.ends[i + 1]]

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self)), self.counts)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, a space after each, and where each text starts."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    starts = offsets - offsets[0] + np.arange(len(offsets))
    out = np.empty(len(raw) + len(column), dtype=np.uint8)
    spot = np.ones(len(out), dtype=bool)
    spot[starts[1:] - 1] = False
    out[spot] = raw
    out[starts[1:] - 1] = 32
    return out, starts


def words(column: pa.Array, table: tuple[np.ndarray, np.ndarray] = PLAIN, stem: int = 0) -> Words:
    """Hash the words of a batch of texts; a null text has none.

    With ``stem``, the first bytes of each word, A-Z lowered, are hashed as well.
    """
    inside, value = table
    text, starts = _joined(column)
    hashes: list[np.ndarray] = []
    stems: list[np.ndarray] = []
    begins: list[np.ndarray] = []
    at = 0
    while at < len(text):
        to = min(at + PIECE, len(text))
        while to < len(text) and inside[text[to - 1]]:
            step = text[to : to + 4096]
            gap = np.flatnonzero(~inside[step])
            to += int(gap[0]) + 1 if len(gap) else len(step)
        piece = text[at:to]
        mask = inside[piece]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
        first, last = edge[0::2], edge[1::2]
        up, down = powers(_BASE, len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(value[piece] * up[: len(piece)], out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        if stem:
            np.cumsum(FOLDED[1][piece] * up[: len(piece)], out=sums[1:])
            last = np.minimum(last, first + stem)
            stems.append(mix((sums[last] - sums[first]) * down[first]))
        begins.append(first + at)
        at = to
    if not hashes:
        return Words(np.zeros(0, np.uint64), np.zeros(len(starts), np.int64), np.zeros(0, np.uint64))
    ends = np.searchsorted(np.concatenate(begins), starts).astype(np.int64)
    return Words(np.concatenate(hashes), ends, np.concatenate(stems) if stem else None)


class Runs:
    """Hashes of runs of consecutive words, of any length, from prefix sums."""

    def __init__(self, hashes: np.ndarray, base: np.uint64 = RUN_BASES[0]) -> None:
        up, self.down = powers(base, len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum((hashes ^ base) * up[: len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of the run at each start; the caller keeps runs inside one text."""
        total = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return mix(total + np.asarray(length).astype(np.uint64))


def window_starts(found: Words, size: int) -> np.ndarray:
    """Start of each run of ``size`` words that lies inside one text."""
    counts = np.maximum(found.counts - size + 1, 0)
    total = int(counts.sum())
    begin = np.repeat(found.ends[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return begin + np.arange(total)


def shingle_starts(found: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each shingle, and how many each text has.

    A text of fewer words, but not none, has one shingle: the whole sequence.
    """
    counts = np.maximum(found.counts - size + 1, np.minimum(found.counts, 1))
    total = int(counts.sum())
    begin = np.repeat(found.ends[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    length = np.repeat(np.minimum(found.counts, size), counts)
    return begin + np.arange(total), length, counts


def as_long(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))

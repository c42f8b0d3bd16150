"""Alignment of two tokenizers by pointer jumping, and how often the corpus links their ids.

All tokens of a slice of documents lie on one line of bytes. Every token points to the
token of the other side that reaches farthest right among those that overlap it;
doubling these successors takes all tokens to the last token of their component, so a
chain of n overlapping tokens is labelled after log2(n) steps.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemap.llm.rows import keyed, send
from telemap.llm.words import slices
from telemap.session import cut, settled

#: where the vocabulary files of the two tokenizers lie
FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: splits text before merges; fixed by the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the quick engine's expressions run out of stack on runs of white space far longer than this
LONG_GAP = 1000
#: bytes of text that are aligned at once
SLICE = 2 << 20


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Pair:
    """Both vocabularies as read from their files; a task builds the encoders it uses."""

    byte_json: str
    piece_model: bytes
    made: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"byte_json": self.byte_json, "piece_model": self.piece_model, "made": {}}

    def load(self) -> Pair:
        import sentencepiece
        import tiktoken

        spec = json.loads(self.byte_json)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        quick = tiktoken.Encoding("pair", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = sentencepiece.SentencePieceProcessor(model_proto=self.piece_model)
        b_bytes = [
            bytes([int(pieces.id_to_piece(i)[3:5], 16)])
            if pieces.is_byte(i)
            else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in range(pieces.get_piece_size())
        ]
        self.made = {
            "quick": quick,
            "pieces": pieces,
            "a_bytes": a_bytes,
            "b_bytes": b_bytes,
            "a_size": np.array([len(x) for x in a_bytes]),
            "b_size": np.array([len(x) for x in b_bytes]),
            "gap": re.compile(r"\s{%d}" % LONG_GAP),
        }
        return self

    def encode_a(self, text: str) -> list[int]:
        """Ids of the byte-level vocabulary; the strings of special tokens are plain text."""
        if not self.made["gap"].search(text):
            return self.made["quick"].encode_ordinary(text)
        if "slow" not in self.made:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_str(self.byte_json)
            slow.encode_special_tokens = True
            self.made["slow"] = slow
        return self.made["slow"].encode(text, add_special_tokens=False).ids

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.made["pieces"].encode(texts, num_threads=1)


def read_pair(folder: str = FOLDER) -> Pair:
    """Both vocabularies, read by the driver; a few MB that are sent to the tasks."""
    with open(os.path.join(folder, BYTE_FILE), encoding="utf-8") as f:
        spec = f.read()
    with open(os.path.join(folder, PIECE_FILE), "rb") as f:
        return Pair(spec, f.read())


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every A and every B token the B token that ends its component, by pointer jumping.

    Ends are byte offsets in order; both sides end at the same last byte.
    """
    n = len(a_ends)
    over_b = np.searchsorted(b_ends, a_ends)
    over_a = np.searchsorted(a_ends, b_ends)
    own = np.arange(len(b_ends))
    farther = a_ends[over_a] > b_ends if len(b_ends) else np.zeros(0, dtype=bool)
    successor = np.concatenate((n + over_b, np.where(farther, over_a, n + own)))
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            return doubled[:n] - n, doubled[n:] - n
        successor = doubled


@dataclass
class Aligned:
    """Tokens and groups of a slice of documents, end to end."""

    full: np.ndarray  # documents with tokens
    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray  # a[a_at[i]:a_at[i + 1]] are those of document i
    b_at: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_at: np.ndarray
    ends: np.ndarray  # of the groups, in bytes from the start of the slice
    starts: np.ndarray  # of the documents, likewise
    link_a: np.ndarray  # last A and B token of each group: the ranges that end together
    link_b: np.ndarray


def align_slice(texts: list[str | None], pair: Pair) -> Aligned:
    made = pair.made
    spaced = [" " + t if t else None for t in texts]
    some = [i for i, t in enumerate(spaced) if t is not None]
    a_ids = {i: pair.encode_a(spaced[i]) for i in some}
    b_ids = dict(zip(some, pair.encode_b([texts[i] for i in some])))
    a_bytes, b_bytes = made["a_bytes"].__getitem__, made["b_bytes"].__getitem__
    full = np.zeros(len(texts), dtype=bool)
    for i in some:
        want = spaced[i].encode()
        full[i] = b"".join(map(a_bytes, a_ids[i])) == want and b"".join(map(b_bytes, b_ids[i])) == want
    used = np.flatnonzero(full).tolist()

    def line(ids: dict[int, list[int]], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[used] = [len(ids[i]) for i in used]
        flat = np.concatenate([np.array(ids[i], dtype=np.int64) for i in used]) if used else np.zeros(0, np.int64)
        return flat, np.concatenate(([0], np.cumsum(counts))), np.cumsum(size[flat])

    a, a_at, a_ends = line(a_ids, made["a_size"])
    b, b_at, b_ends = line(b_ids, made["b_size"])
    a_last, b_last = terminals(a_ends, b_ends)
    is_last = b_last == np.arange(len(b))
    nth = np.cumsum(is_last) - 1
    ends = b_ends[is_last]
    group_at = np.concatenate(([0], np.cumsum(is_last)))[b_at]
    starts = np.concatenate(([0], ends))[group_at[:-1]]
    return Aligned(
        full, a, b, a_at, b_at, nth[a_last], nth[b_last], group_at, ends, starts, a[np.searchsorted(a_ends, ends)], b[is_last]
    )


def digests(found: Aligned, table: list[str]) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2`` for each document, ids in decimal; empty without tokens.

    ``table`` holds each id with each of the three marks after it.
    """
    a_groups, b_groups = found.a_group, found.b_group
    n_groups = len(found.ends)
    a_to = np.cumsum(np.bincount(a_groups, minlength=n_groups))
    b_to = np.cumsum(np.bincount(b_groups, minlength=n_groups))
    b_from = np.concatenate(([0], b_to))[:n_groups]
    a_close = np.zeros(len(found.a), dtype=np.int64)
    a_close[a_to - 1] = 1
    b_close = np.zeros(len(found.b), dtype=np.int64)
    b_close[b_to - 1] = 2
    codes = np.empty(len(found.a) + len(found.b), dtype=np.int64)
    codes[np.arange(len(found.a)) + b_from[a_groups]] = 3 * found.a + a_close
    codes[np.arange(len(found.b)) + a_to[b_groups]] = 3 * found.b + b_close
    at = found.a_at + found.b_at
    mark = table.__getitem__
    return [
        hashlib.sha256("".join(map(mark, codes[at[i] : at[i + 1]].tolist()))[:-1].encode()).hexdigest() if full else ""
        for i, full in enumerate(found.full.tolist())
    ]


GROUPS = "doc_id long, ord long, th long, n_a long, n_b long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>"


def token_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """``doc_id, ord, th, n_a, n_b, groups``: the aligned groups of each row of ``docs``.

    A group has its bytes in the text with a space before it (``start``, ``end``) and the
    ids of both sides. A text that is null or empty, or that either side does not give
    back byte by byte, has no tokens and no groups.
    """
    sent = send(docs.sparkSession, read_pair(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = sent().load()
        for batch in slices(batches, "text", SLICE):
            found = align_slice(batch.column("text").to_pylist(), pair)
            n = len(found.ends)
            begin = np.concatenate(([0], found.ends))[:n]
            base = np.repeat(found.starts, np.diff(found.group_at))

            def lists(ids: np.ndarray, group: np.ndarray) -> pa.Array:
                at = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n)))).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))

            rows = pa.StructArray.from_arrays(
                [pa.array(begin - base), pa.array(found.ends - base), lists(found.a, found.a_group), lists(found.b, found.b_group)],
                names=["start", "end", "a", "b"],
            )
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("doc_id", "ord", "th")}
                | {
                    "n_a": pa.array(np.diff(found.a_at)),
                    "n_b": pa.array(np.diff(found.b_at)),
                    "groups": pa.ListArray.from_arrays(pa.array(found.group_at.astype(np.int32)), rows),
                }
            )

    return keyed(docs, key, text).mapInArrow(run, GROUPS)


#: pairs of a slice that lie in one row
PAIR_ROWS = 4096
#: a row for each document, with the place of each of its links among the pairs of its slice; then these pairs
SLICES = (
    "slice long, doc_id long, ord long, th long, n_a long, n_b long, n_links long, digest string, links binary,"
    " pairs array<long>, counts array<long>"
)


def _sliced(docs: DataFrame, folder: str) -> DataFrame:
    sent = send(docs.sparkSession, read_pair(folder))
    kinds = {"digest": pa.string(), "links": pa.binary(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in SLICES.split(",")])

    def rows(number: int, columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        whole = {"slice": np.full(n, number)} | columns
        arrays = [pa.array(whole[f.name], f.type) if f.name in whole else pa.nulls(n, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = sent().load()
        ids = max(len(pair.made["a_bytes"]), len(pair.made["b_bytes"]))
        table = [f"{i}{mark}" for i in range(ids) for mark in ",|;"]
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", SLICE):
            found = align_slice(batch.column("text").to_pylist(), pair)
            pairs, where, counts = np.unique(
                (found.link_a << np.int64(31)) | found.link_b, return_inverse=True, return_counts=True
            )
            links, at = where.astype(np.int32), found.group_at
            yield rows(
                number,
                {c: batch.column(c) for c in ("doc_id", "ord", "th")}
                | {
                    "n_a": np.diff(found.a_at),
                    "n_b": np.diff(found.b_at),
                    "n_links": np.diff(at),
                    "digest": digests(found, table),
                    "links": [links[i:j].tobytes() for i, j in zip(at[:-1], at[1:])],
                },
            )
            cuts = range(0, len(pairs), PAIR_ROWS)
            if len(cuts):
                yield rows(number, {k: [x[i : i + PAIR_ROWS] for i in cuts] for k, x in (("pairs", pairs), ("counts", counts))})
            number += 1

    return docs.select("doc_id", "ord", "th", "text").mapInArrow(run, SLICES)


ALIGNED = (
    "doc_id long, ord long, th long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
    " groups_sha256 string"
)


def pair_counts(sliced: DataFrame) -> DataFrame:
    """``pair, total, best``: links of the corpus with an id pair, and whether its B id has no commoner pair."""
    packed = sliced.filter("pairs IS NOT NULL")
    pairs = packed.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    totals = pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total"))
    totals = cut(totals.withColumn("b", F.col("pair").bitwiseAND((1 << 31) - 1)))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """``doc_id, ord, th, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row of ``docs``.

    A is the byte-level vocabulary, applied to a space and the text; B the vocabulary of
    pieces, which adds that space itself. Offsets where tokens of both end cut them into
    groups. A link is a pair of tokens of both that end together; ``count_sum`` adds up,
    over the links of a row, how many links of all rows have the same two ids, and
    ``n_best`` counts the links that are the commonest of their B id, ties included.
    Rows that are repeated count each; ids may repeat or be null. Texts that are null or
    empty, or that a side does not give back byte by byte, have zeros and an empty digest.

    A slice of documents asks for the counts of its different pairs once, so the work of
    the shuffle follows the different pairs of each slice and not the tokens. Answers are
    rows that a task gets slice by slice, so memory follows the size of a slice.
    """
    return settled(lambda: _aligned(cut(_sliced(keyed(docs, key, text), folder))))


def _aligned(sliced: DataFrame) -> DataFrame:
    asked = sliced.filter("pairs IS NOT NULL").select(F.col("slice").alias("to"), F.explode("pairs").alias("pair"))
    told = asked.join(pair_counts(sliced), "pair").select("to", "pair", "total", "best")

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("pair")
        at = np.concatenate(([0], np.cumsum(docs.column("n_links").to_numpy())))
        links = np.frombuffer(b"".join(docs.column("links").to_pylist()), dtype=np.int32)

        def summed(column: str) -> pa.Array:
            values = told.column(column).to_numpy().astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(values[links])))
            return pa.array(sums[at[1:]] - sums[at[:-1]], pa.int64())

        return pa.table(
            {c: docs.column(c) for c in ("doc_id", "ord", "th", "n_a", "n_b")}
            | {"n_groups": docs.column("n_links"), "n_links": docs.column("n_links"), "n_best": summed("best"), "count_sum": summed("total")}
            | {"groups_sha256": docs.column("digest")}
        )

    docs = sliced.filter("pairs IS NULL").drop("pairs", "counts")
    return docs.groupBy("slice").cogroup(told.groupBy("to")).applyInArrow(run, ALIGNED)

"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps.

Vectors are ordered along a Hilbert curve and written as Parquet rows of ``BLOCK``
vectors, each with the least and greatest value of every dimension and its labels. Interval
arithmetic bounds the inner products of an anchor with a block from both sides; a block
is read for a tile of anchors only if a product in it can lie in a window of one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemap.llm.rows import in_ranges, prefix_sums, send
from telemap.session import cut

#: vectors in a block, blocks in a zone, anchors in a tile
BLOCK, ZONE, TILE = 512, 32, 1024
#: the curve runs through the dimensions that vary most: 21 of them at 3 bits fill a long
CURVE_DIMS, CURVE_BITS = 21, 3
#: components become floor(SCALE * x), clipped so that scores of up to 2,048 components fit a long
SCALE, CLIP = 256.0, 1 << 26
#: found entries that a task keeps before it cuts them to the best of each window
KEPT = 200_000
NONE = -(1 << 62)


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Components as whole numbers; missing ones at the end of a shorter vector are 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return np.clip(np.floor(SCALE * out), -CLIP, CLIP).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points given by ``bits`` bits in each dimension."""
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


def products(a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
    """Exact inner products of whole numbers of at most ``top``."""
    if a.shape[1] * top * top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def interval(a: np.ndarray, low: np.ndarray, high: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of each ``a`` with what lies between each ``low`` and ``high``."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low, top) + products(down, high, top), products(up, high, top) + products(down, low, top)


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Mean and deviation of each dimension and the greatest absolute value, or None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            width = int(sizes.max(initial=0))
            x = padded(batch.column("vec"), width)
            y = x.astype(np.float64)
            yield pa.RecordBatch.from_pydict(
                {"n": [len(x)], "top": [int(np.abs(x).max(initial=0))], "sums": [y.sum(axis=0)], "squares": [(y * y).sum(axis=0)]},
                schema=pa.schema([("n", pa.int64()), ("top", pa.int64()), ("sums", pa.list_(pa.float64())), ("squares", pa.list_(pa.float64()))]),
            )

    parts = cut(rows.select("vec").mapInArrow(run, "n long, top long, sums array<double>, squares array<double>"))
    n, top = parts.agg(F.sum("n"), F.max("top")).first()
    if not n:
        return None
    each = parts.select(F.posexplode(F.arrays_zip("sums", "squares")).alias("dim", "x"))
    dims = each.groupBy("dim").agg(F.sum("x.sums").alias("s"), F.sum("x.squares").alias("q")).orderBy("dim").collect()  # one for each dimension
    mean = np.array([r.s for r in dims]) / n
    return mean, np.sqrt(np.maximum(np.array([r.q for r in dims]) / n - mean**2, 0)), top


def _coded(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray, top: int) -> DataFrame:
    """``id, label, anchor, code, vec`` (packed): each row with its place on the curve."""
    width = len(mean)
    axes = np.argsort(-deviation, kind="stable")[:CURVE_DIMS]
    kind = np.int16 if top < 1 << 15 else np.int32
    sent = send(rows.sparkSession, (mean[axes], np.maximum(deviation[axes], 1e-9)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, spread = sent()
        for batch in batches:
            x = padded(batch.column("vec"), width)
            cells = np.floor(((x[:, axes] - middle) / spread + 2) / 4 * (1 << CURVE_BITS))
            codes = hilbert_keys(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS) if len(axes) else np.zeros(len(x), np.int64)
            packed = x.astype(kind)
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("id", "label", "anchor")}
                | {"code": pa.array(codes), "vec": pa.array([v.tobytes() for v in packed], pa.binary())}
            )

    return rows.select("id", "label", "anchor", "vec").mapInArrow(run, "id long, label long, anchor boolean, code long, vec binary")


BLOCKS = "block long, zone long, n int, ids binary, labels binary, vecs binary, low binary, high binary, kinds array<long>"


def _blocks(coded: DataFrame, width: int, kind: type) -> DataFrame:
    """The blocks, as a Parquet table in the order of the curve."""
    spark = coded.sparkSession
    keys = ["code", "id", "tie"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = coded.drop("anchor").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rest = TaskContext.get().partitionId(), 0, None

        def packed(table: pa.Table) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(table["vec"].to_pylist()), dtype=kind).reshape(len(table), width)
            labels = table["label"].to_numpy()
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([part << 32 | number], pa.int64()),
                    "zone": pa.array([part << 32 | number // ZONE], pa.int64()),
                    "n": pa.array([len(table)], pa.int32()),
                    "ids": pa.array([table["id"].to_numpy().tobytes()], pa.binary()),
                    "labels": pa.array([labels.tobytes()], pa.binary()),
                    "vecs": pa.array([x.tobytes()], pa.binary()),
                    "low": pa.array([x.min(axis=0).tobytes()], pa.binary()),
                    "high": pa.array([x.max(axis=0).tobytes()], pa.binary()),
                    "kinds": pa.array([np.unique(labels)], pa.list_(pa.int64())),
                }
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while len(rest) >= BLOCK:
                yield packed(rest.slice(0, BLOCK))
                rest, number = rest.slice(BLOCK), number + 1
        if rest is not None and len(rest):
            yield packed(rest)

    return cut(ranged.select("id", "label", "vec").mapInArrow(run, BLOCKS))


def _tiles(coded: DataFrame) -> tuple[DataFrame, int]:
    """Anchors in the order of the curve, ``TILE`` in a row; and the number of tiles."""
    one = coded.filter("anchor").groupBy("id").agg(F.min(F.struct("label", "code", "vec")).alias("v")).select("id", "v.*")
    ranked = prefix_sums(in_ranges(one, F.col("code"), F.col("id")), F.lit(0))
    placed = ranked.select(F.expr(f"rank div {TILE}").alias("tile"), F.expr(f"cast(rank % {TILE} as int)").alias("slot"), "row.id", "row.label", "row.vec")
    tiles = cut(placed.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("slot", "id", "label", "vec"))).alias("anchors")))
    return tiles, tiles.count()


class Tile:
    """A tile's anchors and the scores known of them, in NumPy."""

    def __init__(self, anchors: pa.StructScalar, known, width: int, kind: type, positives: int) -> None:
        rows = anchors.values
        self.ids = rows.field("id").to_numpy()
        self.labels = rows.field("label").to_numpy()
        self.vecs = np.frombuffer(b"".join(rows.field("vec").to_pylist()), dtype=kind).reshape(len(rows), width).astype(np.int64)
        self.known = np.full((len(rows), positives), NONE, dtype=np.int64)
        if known is not None and known.is_valid and len(known.values):
            k = known.values
            self.known[k.field("slot").to_numpy(), k.field("nth").to_numpy()] = k.field("score").to_numpy()


def windows(known: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score s with low * p <= 100 * s <= high * p, for each known p; 1 and 0 for none."""
    least, most = -(-low * known // 100), high * known // 100
    none = known == NONE
    return np.where(none, 1, least), np.where(none, 0, most)


def _wanted(job: str, tile: Tile, lower: np.ndarray, upper: np.ndarray, same: np.ndarray, other: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which anchors (rows) must read which blocks (columns)."""
    if job == "same":  # a fifth best is known: only blocks that can reach it
        return same & (upper >= tile.known.min(axis=1)[:, None])
    least, most = windows(tile.known, low, high)
    some = least <= most
    floor = np.where(some, least, 1 << 62).min(axis=1)
    roof = np.where(some, most, NONE).max(axis=1)
    return other & (upper >= floor[:, None]) & (lower <= roof[:, None])


def _ask(job: str, tiles: DataFrame, n_tiles: int, zones: DataFrame, shape: tuple) -> DataFrame:
    """``tile, zone, block, top``: the blocks that a tile has to read, by their zone maps.

    For the job "seed" it is the most promising block of each anchor.
    """
    width, kind, top, positives, low, high = shape
    seed = job == "seed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tile = Tile(batch.column("anchors")[i], batch.column("known")[i], width, kind, positives)
                maps = batch.column("maps")[i].values
                lows, highs = (
                    np.frombuffer(b"".join(maps.field(c).to_pylist()), dtype=kind).reshape(len(maps), width).astype(np.int64) for c in ("low", "high")
                )
                lower, upper = interval(tile.vecs, lows, highs, top)
                kinds = maps.field("kinds").to_pylist()
                same = np.stack([np.isin(tile.labels, k) for k in kinds], axis=1)
                other = np.stack([~np.isin(tile.labels, k) | (len(k) > 1) for k in kinds], axis=1)
                blocks = maps.field("block").to_numpy()
                if seed:
                    upper = np.where(same, upper, NONE)
                    at = upper.argmax(axis=1)
                    best = upper[np.arange(len(at)), at]
                    slot = np.flatnonzero(best > NONE)
                    found = {"slot": slot.astype(np.int32), "block": blocks[at[slot]], "top": best[slot]}
                else:
                    need = _wanted(job, tile, lower, upper, same, other, low, high)
                    used = np.flatnonzero(need.any(axis=0))
                    found = {"slot": np.zeros(len(used), np.int32), "block": blocks[used], "top": np.where(need, upper, NONE).max(axis=0)[used]}
                n = len(found["block"])
                yield pa.RecordBatch.from_pydict(
                    {"tile": pa.array([batch.column("tile")[i].as_py()] * n, pa.int64()), "zone": pa.array([batch.column("zone")[i].as_py()] * n, pa.int64())}
                    | {c: pa.array(v) for c, v in found.items()}
                )

    each = zones.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))))
    asked = each.join(tiles, "tile").select("tile", "zone", "maps", "anchors", "known").mapInArrow(run, "tile long, zone long, slot int, block long, top long")
    if seed:
        best = asked.groupBy("tile", "slot").agg(F.max(F.struct("top", "zone", "block")).alias("b"))
        asked = best.groupBy("tile", "b.zone", "b.block").agg(F.max("b.top").alias("top"))
    return cut(asked.select("tile", "zone", "block", "top"))


FOUND = "tile long, slot int, nth int, score long, id long"


def _visit(job: str, tiles: DataFrame, asked: DataFrame, blocks: DataFrame, shape: tuple, keep: int) -> DataFrame:
    """The ``keep`` best rows of each window that the asked blocks hold; ties go to the smaller id.

    A task gets a tile and the blocks of a zone that it needs, best bound first, so that
    bounds soon rule out the rest for most anchors.
    """
    width, kind, top, positives, low, high = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, number, held, count, bar = None, None, [], 0, None

        def settle() -> None:
            """Keep the best of each window and raise the bars of full ones."""
            nonlocal held, count
            if not held:
                return
            slot, nth, score, ids = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((ids, -score, nth, slot))
            slot, nth, score, ids = slot[order], nth[order], score[order], ids[order]
            window = slot.astype(np.int64) * positives + nth
            first = np.searchsorted(window, window)
            place = np.arange(len(window)) - first
            full = place == keep - 1
            bar[slot[full], nth[full]] = np.maximum(bar[slot[full], nth[full]], score[full])
            best = place < keep
            held, count = [(slot[best], nth[best], score[best], ids[best])], 0

        def told() -> Iterator[pa.RecordBatch]:
            settle()
            for slot, nth, score, ids in held:
                yield pa.RecordBatch.from_pydict(
                    {"tile": pa.array(np.full(len(slot), number)), "slot": pa.array(slot.astype(np.int32)), "nth": pa.array(nth.astype(np.int32))}
                    | {"score": pa.array(score), "id": pa.array(ids)}
                )

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("anchors")[i].is_valid:  # the first row of each tile and zone
                    if tile is not None:
                        yield from told()
                    tile, number, held, count = Tile(batch.column("anchors")[i], batch.column("known")[i], width, kind, positives), batch.column("tile")[i].as_py(), [], 0
                    least, most = windows(tile.known, low, high)
                    bar = np.full((len(tile.ids), positives), NONE, dtype=np.int64)
                    if job == "same":
                        bar[:, 0] = tile.known.min(axis=1)
                    continue
                get = lambda c, t=np.int64: np.frombuffer(batch.column(c)[i].as_py(), dtype=t)
                ids, labels = get("ids"), get("labels")
                lower, upper = interval(tile.vecs, get("low", kind)[None].astype(np.int64), get("high", kind)[None].astype(np.int64), top)
                lower, upper = lower[:, 0], upper[:, 0]
                if job == "other":
                    open_ = (least <= most) & (lower[:, None] <= most) & (upper[:, None] >= np.maximum(least, bar))
                    use = np.flatnonzero(open_.any(axis=1))
                else:
                    use = np.flatnonzero(upper >= bar[:, 0])
                if not len(use):
                    continue
                score = products(tile.vecs[use], get("vecs", kind).reshape(len(ids), width), top)
                alike = tile.labels[use][:, None] == labels[None]
                alone = tile.ids[use][:, None] != ids[None]
                fit = alone & (~alike if job == "other" else alike)
                for nth in range(positives if job == "other" else 1):
                    inside = fit & (score >= bar[use, nth][:, None])
                    if job == "other":
                        inside &= (score >= least[use, nth][:, None]) & (score <= most[use, nth][:, None])
                    row, col = np.nonzero(inside)
                    held.append((use[row], np.full(len(row), nth), score[row, col], ids[col]))
                    count += len(row)
                if count > KEPT or job != "other":
                    settle()
        if tile is not None:
            yield from told()

    head = asked.select("tile", "zone").distinct().join(tiles, "tile").withColumn("top", F.lit((1 << 63) - 1))
    body = asked.join(blocks.drop("zone", "kinds", "n"), "block").drop("block")
    both = head.unionByName(body, allowMissingColumns=True).repartition("tile", "zone").sortWithinPartitions("tile", "zone", F.desc("top"))
    found = both.drop("zone", "top").mapInArrow(run, FOUND)
    best = Window.partitionBy("tile", "slot", "nth").orderBy(F.desc("score"), "id")
    return cut(found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep))


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(256 * x)``; a score is the inner product of two rows, ties go
    to the smaller id. The positives of an anchor are its best rows of the same label. For
    each, the best rows of other labels whose score is ``low`` to ``high`` per cent of the
    positive's come back, ranked from 1. Rows with a null id, label, vector or component,
    or one that is not finite, take no part. Rows with an anchor's id are neither positives
    nor negatives of it; of anchors that share an id the first by label counts; other
    repeated rows count each. Shorter vectors are filled up with zeros, and components
    beyond 2**26 / 256 are clipped. Other columns are ignored, and empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<double>").alias("vec"),
    ).filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    moments = _moments(rows)
    if moments is None:
        return spark.createDataFrame([], MINED)
    mean, deviation, top = moments
    kind = np.int16 if top < 1 << 15 else np.int32
    shape = (len(mean), kind, top, positives, low, high)
    coded = cut(_coded(rows, mean, deviation, top))
    tiles, n_tiles = _tiles(coded)
    if not n_tiles:
        return spark.createDataFrame([], MINED)
    blocks = _blocks(coded, len(mean), kind)
    maps = blocks.groupBy("zone").agg(F.collect_list(F.struct("block", "low", "high", "kinds")).alias("maps"))
    zones = cut(maps)

    def knowing(found: DataFrame | None, full: int) -> DataFrame:
        """Tiles with the scores found so far; with ``full`` only of anchors that have so many."""
        if found is None:
            return tiles.withColumn("known", F.lit(None).cast("array<struct<slot:int,nth:int,score:long>>"))
        known = found.withColumn("nth", F.col("place") - 1)
        if full:
            enough = F.count("*").over(Window.partitionBy("tile", "slot"))
            known = known.withColumn("many", enough).filter(F.col("many") >= full)
        packs = known.groupBy("tile").agg(F.collect_list(F.struct("slot", "nth", "score")).alias("known"))
        return cut(tiles.join(packs, "tile", "left"))

    plain = knowing(None, 0)
    seeds = _visit("same", plain, _ask("seed", plain, n_tiles, zones, shape), blocks, shape, positives)
    barred = knowing(seeds, positives)
    same = _visit("same", barred, _ask("same", barred, n_tiles, zones, shape), blocks, shape, positives)
    windowed = knowing(same, 0)
    other = _visit("other", windowed, _ask("other", windowed, n_tiles, zones, shape), blocks, shape, negatives)

    names = tiles.select("tile", F.explode("anchors").alias("a")).select("tile", "a.slot", F.col("a.id").alias("anchor_id"))
    chosen = same.select("tile", "slot", (F.col("place") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = other.select("tile", "slot", "nth", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    mined = hard.join(chosen, ["tile", "slot", "nth"]).join(names, ["tile", "slot"])
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

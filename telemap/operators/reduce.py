"""Low-rank vectors: truncated SVD of sparse triples, of folded bags and of dense rows.

All of them follow the randomised range finder of Halko, Martinsson and Tropp
(2011).  The driver only ever sees square matrices of the sketch width; the
sketches themselves stay distributed as ``(id, vec)`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from telemap.session import cut, forget

OVERSAMPLE = 10
POWER = 2
# Numbers of a sketch that a slab may meet, numbers it adds up at a time, and its entries.
BLOCK_CELLS = 16_000_000
STEP_CELLS = 4_000_000
MAX_TILE_ENTRIES = 1_000_000
MIN_TILE_ENTRIES = 50_000
# Numbers of a sketch that may be on their way to slabs at a time.
WAVE_CELLS = 250_000_000
# Tasks that join R factors before the last one does.
BRANCHES = 16


def _vec_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("id", id_type), T.StructField("vec", T.ArrayType(T.DoubleType()))]
    )


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def sum_vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """Elementwise sum of ``vec`` per key, combined in the map task first."""
    total = vector_to_array(Summarizer.sum(array_to_vector("vec")))
    return rows.groupBy(*keys).agg(total.alias("vec"))


def _matrix(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The vectors of some rows, one to a line."""
    vec = rows.column("vec")
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)


def _lists(y: np.ndarray) -> pa.ListArray:
    """The lines of a matrix as a column of lists."""
    ends = np.arange(len(y) + 1, dtype=np.int32) * np.int32(y.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(y).ravel()))


def _numbered(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Number of each value, and the distinct values in the order of their numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def sum_by_id(rows: DataFrame) -> DataFrame:
    """Elementwise sum of ``vec`` per ``id`` where few rows share an id.

    Each task adds up its share of the ids batch by batch; what it holds is one
    vector per distinct id of a shuffle partition.
    """

    def add(held: list) -> tuple[pa.Array, np.ndarray]:
        code, names = _numbered(pa.chunked_array([ids for ids, _ in held]))
        vecs = np.concatenate([vecs for _, vecs in held])
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(names)))
        return names, np.add.reduceat(vecs[order], first, axis=0)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        waiting, summed = 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append((batch.column("id"), _matrix(batch)))
            waiting += batch.num_rows
            if waiting > max(200_000, summed):
                held, waiting = [add(held)], 0
                summed = len(held[0][0])
        if held:
            names, sums = add(held)
            for start in range(0, len(names), 10_000):
                part = slice(start, start + 10_000)
                yield pa.RecordBatch.from_pydict({"id": names[part], "vec": _lists(sums[part])})

    schema = _vec_schema(rows.schema["id"].dataType)
    return rows.select("id", "vec").repartition("id").mapInArrow(total, schema)


def sum_partials(parts: DataFrame) -> np.ndarray:
    """Sum one small array per partition, in two levels."""
    halfway = sum_vectors(parts.withColumn("_g", F.pmod(F.col("part"), F.lit(64))), "_g")
    row = sum_vectors(halfway.withColumn("_all", F.lit(0)), "_all").first()
    return np.asarray(row["vec"]) if row else np.zeros(0)


def _triangle(rows: DataFrame, width: int) -> np.ndarray:
    """R factor of distributed rows: one for each task, then a tree of them.

    What travels are rows of R factors, at most ``width`` from each task.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.vstack((r, _matrix(batch))), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"vec": _lists(r)})

    parts = rows.select("vec").mapInArrow(reduced, "vec array<double>")
    for tasks in (BRANCHES, 1):
        parts = parts.repartition(tasks).mapInArrow(reduced, "vec array<double>")
    found = [row["vec"] for row in parts.toLocalIterator()]
    return np.array(found) if found else np.zeros((1, width))


def _times(rows: DataFrame, *matrices: np.ndarray) -> DataFrame:
    """Each row vector times small matrices, one after the other; no shuffle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch)
                for matrix in matrices:
                    y = y @ matrix
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "vec": _lists(y)})

    return rows.select("id", "vec").mapInArrow(apply, _vec_schema(rows.schema["id"].dataType))


def _orthonormal(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Matrices that, applied in turn, make the rows' columns orthonormal.

    Two passes: rounding of the first spoils the angles of the smallest directions,
    which the second mends. Only directions that rounding cannot tell from zero go.
    """
    steps: list[np.ndarray] = []
    for _ in range(2):
        _, sizes, turn = np.linalg.svd(_triangle(_times(rows, *steps), width), full_matrices=False)
        keep = sizes > sizes.max() * width * np.finfo(float).eps
        steps.append(turn[keep].T / sizes[keep] if keep.any() else np.zeros((width, 1)))
        width = steps[-1].shape[1]
    return steps


def _weighted_sums(out: np.ndarray, inn: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of ``w * x[inn]`` by ``out``, which ascends; a bounded number of entries at a time."""
    y = np.zeros((int(out[-1]) + 1, x.shape[1]))
    step = max(1, STEP_CELLS // x.shape[1])
    for start in range(0, len(w), step):
        part = slice(start, start + step)
        first = np.flatnonzero(np.diff(out[part], prepend=-1))
        y[out[part][first]] += np.add.reduceat(x[inn[part]] * w[part, None], first, axis=0)
    return y


def _union(tables: list[DataFrame]) -> DataFrame:
    """Written tables as one; they are known by it, so that :func:`_drop` finds them."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    whole._tables = list(tables)
    return whole


def _written(df: DataFrame) -> DataFrame:
    """The table, written unless it lies in written tables already."""
    return df if hasattr(df, "_tables") else _union([cut(df)])


def _drop(df: DataFrame) -> None:
    """Delete what :func:`_written` wrote."""
    forget(*df._tables)


def _replaced(df: DataFrame, old: DataFrame) -> DataFrame:
    """The table, written; the one it was made from is deleted."""
    new = _written(df)
    _drop(old)
    return new


class TripleMatrix:
    """A sparse matrix ``(row_id, col_id, w)`` cut into slabs of rows that multiply sketches.

    A slab is one record of bounded entry count. What a product sends is, for each slab, a
    sketch row for each of its distinct columns, and back one for each of its rows, which
    lie in no other slab. A row of more entries than a slab should hold is dealt over
    several by its columns; its sums are then added up by id. Slabs of which more than
    ``WAVE_CELLS`` numbers would travel at once are multiplied in waves, one after the
    other, and the shuffles of a wave are deleted before the next.
    """

    def __init__(self, triples: DataFrame, width: int):
        self.width = width
        limit = max(1, min(MAX_TILE_ENTRIES, BLOCK_CELLS // width))
        sizes = triples.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
        size = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("n").alias("most")).first()
        cores = triples.sparkSession.sparkContext.defaultParallelism
        self.slabs = max(1, -(-size["n"] // limit), min(cores, size["n"] // MIN_TILE_ENTRIES))
        self.split = (size["most"] or 0) > limit
        self.row_type = triples.schema["row_id"].dataType
        self.col_type = triples.schema["col_id"].dataType
        deal = F.lit(0).cast("long")
        if self.split:
            long_rows = sizes.filter(F.col("n") > limit).select("row_id", F.ceil(F.col("n") / limit).alias("parts"))
            triples = triples.join(cut(long_rows), "row_id", "left")
            deal = F.when(F.col("parts").isNull(), deal).otherwise(F.pmod(F.xxhash64("col_id"), F.col("parts")))
        slab = F.pmod(F.xxhash64("row_id", deal), F.lit(self.slabs)).cast("int")
        self.tiles = cut(self._pack(triples.select(slab.alias("slab"), "row_id", "col_id", F.col("w").cast("double").alias("w"))))
        self.waves = [self.tiles]
        n_waves = min(self.slabs, -(-size["n"] * width // WAVE_CELLS))
        if n_waves > 1:
            self.waves = [cut(self.tiles.filter(F.pmod("slab", F.lit(n_waves)) == wave)) for wave in range(n_waves)]
            forget(self.tiles)
            self.tiles = _union(self.waves)

    def _pack(self, entries: DataFrame) -> DataFrame:
        def code(entries: pa.Table) -> pa.Table:
            """Number the rows and columns of a slab once for all products."""
            r, rows = _numbered(entries.column("row_id"))
            c, cols = _numbered(entries.column("col_id"))
            order = np.lexsort((c, r))
            lists = {"rows": rows, "cols": cols, "r": r[order], "c": c[order]}
            lists["w"] = entries.column("w").to_numpy()[order]
            packed = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for k, v in lists.items()}
            return pa.table({"slab": entries.column("slab")[:1].combine_chunks()} | packed)

        ints = T.ArrayType(T.IntegerType())
        schema = T.StructType(
            [
                T.StructField("slab", T.IntegerType()),
                T.StructField("rows", T.ArrayType(self.row_type)),
                T.StructField("cols", T.ArrayType(self.col_type)),
                T.StructField("r", ints),
                T.StructField("c", ints),
                T.StructField("w", T.ArrayType(T.DoubleType())),
            ]
        )
        return entries.groupBy("slab").applyInArrow(code, schema)

    def _product(self, sketch: DataFrame, theirs: str, ours: str, wave: int | None = None) -> DataFrame:
        """Each slab times the sketch rows of its ids ``theirs``: a row for each of its ids ``ours``.

        From columns to columns it is the slab and then its transpose.
        """
        tiles = self.tiles if wave is None else self.waves[wave]
        if wave is not None and theirs == "rows" and not self.split:
            slab = F.pmod(F.xxhash64("id", F.lit(0).cast("long")), F.lit(self.slabs))
            sketch = sketch.filter(F.pmod(slab, F.lit(len(self.waves))) == wave)
        places = tiles.select(F.col("slab").alias("to"), F.posexplode(theirs).alias("pos", "id"))
        sent = sketch.select("id", "vec").join(places, "id").select("to", "pos", "vec")
        schema = _vec_schema(self.row_type if ours == "rows" else self.col_type)
        empty = to_arrow_schema(schema).empty_table()

        def multiply(tile: pa.Table, sent: pa.Table) -> pa.Table:
            if not tile.num_rows or not sent.num_rows:
                return empty
            r, c, w = (tile.column(name)[0].values.to_numpy() for name in ("r", "c", "w"))
            x = np.zeros((0, 0))
            for part in sent.to_batches():
                if part.num_rows:
                    vecs = _matrix(part)
                    if not len(x):
                        x = np.zeros((int((c if theirs == "cols" else r).max()) + 1, vecs.shape[1]))
                    x[part.column("pos").to_numpy()] = vecs
            if theirs == "cols":
                x = _weighted_sums(r, c, w, x)
            if ours == "cols":
                order = np.argsort(c, kind="stable")
                x = _weighted_sums(c[order], r[order], w[order], x)
            out = pa.table({"id": tile.column(ours)[0].values, "vec": _lists(x)})
            return pa.Table.from_batches(out.to_batches(max_chunksize=10_000))

        slabs = tiles.select("slab", ours, "r", "c", "w").groupBy("slab")
        return slabs.cogroup(sent.groupBy("to")).applyInArrow(multiply, schema)

    def times(self, x: DataFrame) -> DataFrame:
        """``M x`` for a sketch ``(id = column, vec)``."""
        if len(self.waves) == 1:
            parts = self._product(x, "cols", "rows")
            return sum_by_id(parts) if self.split else parts
        parts = _union([cut(self._product(x, "cols", "rows", wave)) for wave in range(len(self.waves))])
        return _replaced(sum_by_id(parts), parts) if self.split else parts

    def transposed_times(self, y: DataFrame) -> DataFrame:
        """``M' y`` for a sketch ``(id = row, vec)``."""
        return self._to_columns(y, "rows")

    def folded_times(self, x: DataFrame) -> DataFrame:
        """``M' M x`` for a sketch ``(id = column, vec)``; sums of rows stay in their slabs."""
        if not self.split:
            return self._to_columns(x, "cols")
        y = _written(self.times(x))
        return _replaced(self.transposed_times(y), y)

    def _to_columns(self, sketch: DataFrame, theirs: str) -> DataFrame:
        """Products summed up by column; of several waves each adds its own to the sums before."""
        if len(self.waves) == 1:
            parts = self._product(sketch, theirs, "cols")
            return parts if self.slabs == 1 else sum_by_id(parts)
        sums = None
        for wave in range(len(self.waves)):
            parts = self._product(sketch, theirs, "cols", wave)
            if sums is None:
                sums = _union([cut(sum_by_id(parts))])
            else:
                sums = _replaced(sum_by_id(sums.unionByName(parts)), sums)
        return sums

    def columns(self) -> DataFrame:
        return self.tiles.select(F.explode("cols").alias("id")).distinct()

    def forget(self) -> None:
        forget(*self.waves)


class FoldedBag:
    """The square matrix ``diag(s) M'M`` of a weighted bag, never formed.

    A product costs one pass over the bag, so vectors of items come at the price
    of the bag's entries and not of the item pairs.
    """

    def __init__(self, wbag: DataFrame, width: int):
        self.bag = TripleMatrix(wbag, width)
        self.scale = cut(
            wbag.groupBy(F.col("col_id").alias("id")).agg(F.sum("w").cast("double").alias("s"))
        )

    def _scaled(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.scale, "id").select(
            "id", F.transform("vec", lambda v: v * F.col("s")).alias("vec")
        )

    def times(self, x: DataFrame) -> DataFrame:
        found = self.bag.folded_times(x)
        return _replaced(self._scaled(found), found) if hasattr(found, "_tables") else self._scaled(found)

    def transposed_times(self, y: DataFrame) -> DataFrame:
        return self.bag.folded_times(self._scaled(y))

    def columns(self) -> DataFrame:
        return self.scale.select("id")

    def forget(self) -> None:
        self.bag.forget()
        forget(self.scale)


def _random_signs(ids: DataFrame, width: int) -> DataFrame:
    """A sketch of +-1 entries derived from the ids: the same on every run."""
    sign = F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda j: F.when(F.xxhash64("id", j).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0),
    )
    return ids.select("id", sign.alias("vec"))


def _factor(matrix, width: int, k: int, power: int) -> DataFrame:
    """``U S`` of the leading ``k`` components, signs fixed."""
    y = _written(matrix.times(_random_signs(matrix.columns(), width)))
    basis = _orthonormal(y, width)
    for _ in range(power):
        z = _replaced(matrix.transposed_times(_times(y, *basis)), y)
        turn = _orthonormal(z, basis[-1].shape[1])
        y = _replaced(matrix.times(_times(z, *turn)), z)
        basis = _orthonormal(y, turn[-1].shape[1])
    z = _written(matrix.transposed_times(_times(y, *basis)))
    _, sizes, turn = np.linalg.svd(_triangle(z, basis[-1].shape[1]), full_matrices=False)
    _drop(z)
    matrix.forget()
    out = cut(_times(y, *basis, turn[:k].T * sizes[:k]))
    _drop(y)
    return _padded(_times(out, np.diag(_signs(out, len(sizes[:k])))), k)


def _padded(rows: DataFrame, k: int) -> DataFrame:
    """``k`` columns always: zeros where the rank, to rounding, ends."""
    missing = F.greatest(F.lit(0), F.lit(k) - F.size("vec"))
    return rows.select("id", F.concat("vec", F.array_repeat(F.lit(0.0), missing)).alias("vec"))


def _signs(rows: DataFrame, width: int) -> np.ndarray:
    """+1 or -1 per component, so that its entry of largest magnitude is positive."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch)
                top = y[np.argmax(np.abs(y), axis=0), np.arange(width)]
                best = np.where(np.abs(top) > np.abs(best), top, best)
        yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(width, dtype=np.int32)), "v": pa.array(best)})

    tops = (
        rows.select("vec")
        .mapInArrow(partial, "j int, v double")
        .groupBy("j")
        .agg(F.max(F.struct(F.abs("v").alias("a"), "v")).alias("m"))
        .select("j", "m.v")
        .collect()
    )
    out = np.ones(width)
    for row in tops:
        out[row["j"]] = -1.0 if row["v"] < 0 else 1.0
    return out


def truncated_svd(triples: DataFrame, k: int, oversample: int = OVERSAMPLE, power: int = POWER) -> DataFrame:
    """Leading ``k`` columns of ``U S`` of a sparse matrix: ``(id = row, vec)``."""
    width = k + oversample
    return _factor(TripleMatrix(triples, width), width, k, power)


def item_vectors(wbag: DataFrame, k: int, oversample: int = OVERSAMPLE, power: int = POWER) -> DataFrame:
    """Leading ``k`` columns of ``U S`` of a bag's orderless co-occurrence matrix.

    Equal to :func:`truncated_svd` of ``bag_cooccurrence(wbag)``.
    """
    width = k + oversample
    return _factor(FoldedBag(wbag, width), width, k, power)


def token_vectors(cooc: DataFrame, k: int, tokens: DataFrame | None = None) -> DataFrame:
    """Vectors of tokens from a co-occurrence table ``(c1, c2, w)``.

    A token is described by what follows it and, in columns of their own, by what
    precedes it, so one that only ever ends a line has a vector as well. ``tokens``
    (``token``) names tokens that must all come back; those without a neighbour are at
    the origin. Without it the table is taken as it is: rows c1 by what follows.
    """
    if tokens is None:
        return truncated_svd(cooc.select(F.col("c1").alias("row_id"), F.col("c2").alias("col_id"), "w"), k)
    after = cooc.select(F.col("c1").alias("row_id"), F.concat(F.lit("after "), "c2").alias("col_id"), "w")
    before = cooc.select(F.col("c2").alias("row_id"), F.concat(F.lit("before "), "c1").alias("col_id"), "w")
    found = truncated_svd(after.unionByName(before), k)
    every = tokens.select(F.col("token").alias("id")).distinct()
    origin = F.array_repeat(F.lit(0.0), k)
    return every.join(found, "id", "left").select("id", F.coalesce("vec", origin).alias("vec"))


def _rows_matrix(rows: DataFrame, basis: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """``A'(A basis)`` of centred dense rows in one pass."""
    shape = basis.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(shape)
        for pdf in batches:
            if len(pdf):
                a = _stack(pdf["vec"]) - mean
                acc += a.T @ (a @ basis)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "vec": [acc.ravel()]})

    parts = rows.select("vec").mapInPandas(partial, "part int, vec array<double>")
    return sum_partials(parts).reshape(shape)


def compress(
    rows: DataFrame, k: int, oversample: int = OVERSAMPLE, power: int = POWER, centre: bool = False
) -> DataFrame:
    """Dense rows to their leading ``k`` components: ``(id, vec)``.

    Subspace iteration on the row width: what travels is a width x (k +
    oversample) matrix per task, whatever the number of rows.
    """
    first = rows.select("vec").first()
    if first is None:
        return rows.select("id", "vec")
    width = len(first["vec"])
    mean = np.zeros(width)
    if centre:
        total = rows.agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("m"))
        mean = np.asarray(total.first()["m"])
    sketch = min(width, k + oversample)
    rng = np.random.default_rng(0)
    basis = np.linalg.qr(rng.standard_normal((width, sketch)))[0]
    for _ in range(power + 1):
        image = _rows_matrix(rows, basis, mean)
        small = basis.T @ image
        basis = np.linalg.qr(image)[0]
    image = _rows_matrix(rows, basis, mean)
    small = basis.T @ image
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    lead = np.argsort(values)[::-1][:k]
    turn = basis @ vectors[:, lead]
    turn *= np.where(turn[np.argmax(np.abs(turn), axis=0), np.arange(turn.shape[1])] < 0, -1.0, 1.0)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame(
                    {"id": pdf["id"], "vec": list((_stack(pdf["vec"]) - mean) @ turn)}
                )

    return _padded(rows.select("id", "vec").mapInPandas(project, _vec_schema(rows.schema["id"].dataType)), k)


# Widest rows whose covariance MLlib may hold on the driver.
PCA_WIDTH = 1024


def pca_start(vectors: DataFrame, dims: int = 2) -> DataFrame:
    """Start positions of a map: the first principal components, ``(id, x, y)``.

    MLlib's transform does not centre, so the mean is taken off first.
    """
    from pyspark.ml.feature import PCA

    first = vectors.select("vec").first()
    if first is None or len(first["vec"]) > PCA_WIDTH:
        flat = compress(vectors, dims, centre=True)
    else:
        rows = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
        mean = rows.agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m")).first()["m"]
        model = PCA(k=dims, inputCol="v", outputCol="p").fit(rows)
        pc = model.pc.toArray()
        pc = pc * np.where(pc[np.argmax(np.abs(pc), axis=0), np.arange(dims)] < 0, -1.0, 1.0)
        offset = np.asarray(mean) @ pc
        exact = [
            F.aggregate(
                F.zip_with("vec", F.lit(pc[:, i].tolist()), lambda a, b: a * b),
                F.lit(0.0),
                lambda acc, v: acc + v,
            )
            - float(offset[i])
            for i in range(dims)
        ]
        flat = vectors.select("id", F.array(*exact).alias("vec"))
    return flat.select("id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))

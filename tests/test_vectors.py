"""Neighbours, low-rank vectors and transport against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemap.operators import cooccurrence, neighbors, reduce, transport
from telemap.plans import vector_queries


def matrix_rows(spark, m):
    rows = [(i, [float(v) for v in m[i]]) for i in range(len(m))]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def triples(spark, m):
    rows = [
        (int(i), f"c{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m))
    ]
    return spark.createDataFrame(rows, "row_id long, col_id string, w double")


def dense(df, n):
    got = {r["id"]: r["vec"] for r in df.collect()}
    return np.array([got[i] for i in range(n)])


def brute(dist, k, digits=12):
    out = {}
    for i in range(len(dist)):
        d = np.round(dist[i], digits)
        order = sorted((d[j], j) for j in range(len(d)) if j != i and np.isfinite(d[j]))
        out[i] = order[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append((r["dist"], r["neighbor"]))
    return {i: sorted(v) for i, v in out.items()}


@pytest.fixture(scope="module")
def clumpy():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12)) * 4
    m = np.concatenate([c + 0.3 * rng.standard_normal((60, 12)) for c in centres])
    m[100:140] = m[100]  # a group of copies
    return m


@pytest.mark.parametrize("block", [16, 1024])
def test_knn_cosine_exact(spark, clumpy, block):
    u = clumpy / np.linalg.norm(clumpy, axis=1, keepdims=True)
    got = found(neighbors.knn_cosine(matrix_rows(spark, clumpy), 5, block))
    want = brute(1 - u @ u.T, 5)
    assert {i: [j for _, j in v] for i, v in got.items()} == {
        i: [j for _, j in v] for i, v in want.items()
    }


@pytest.mark.parametrize("block,gain", [(8, 128), (1024, 128), (1024, 0.1)])
def test_knn_hellinger_exact(spark, monkeypatch, block, gain):
    monkeypatch.setattr(neighbors, "DENSE_GAIN", gain)
    rng = np.random.default_rng(5)
    m = rng.integers(0, 3, (120, 40)) * (rng.random((120, 40)) < 0.15)
    m[m.sum(1) == 0, 0] = 1
    m[40:80] = m[40]
    m[119] = 0
    m[119, 39] = 1
    m[:119, 39] = 0
    m[m.sum(1) == 0, 0] = 1
    p = np.sqrt(m / m.sum(1, keepdims=True))
    dots = p @ p.T
    dist = np.where(dots > 0, np.sqrt(np.maximum(1 - dots, 0)), np.inf)
    got = found(neighbors.knn_hellinger(triples(spark, m), 4, block))
    want = {i: v for i, v in brute(dist, 4, 9).items() if v}
    assert 119 not in got
    assert {i: [j for _, j in v] for i, v in got.items()} == {
        i: [j for _, j in v] for i, v in want.items()
    }


@pytest.mark.parametrize("rows_of_column", [3, 1024])
def test_short_bags_meet_by_column(spark, monkeypatch, rows_of_column):
    """No blocks are compared, whatever parts a column is dealt into; copies and lone rows too."""
    monkeypatch.setattr(neighbors, "COLUMN_ROWS", rows_of_column)
    monkeypatch.setattr(neighbors, "INDEX_ROWS", 16)
    monkeypatch.setattr(neighbors, "nearest_rows", None)
    rng = np.random.default_rng(8)
    m = np.zeros((200, 150), int)
    for i in range(200):
        m[i, rng.integers(0, 150, rng.integers(1, 6))] = rng.integers(1, 4)
    m[:12, 7] = 1
    m[20:30] = m[20]
    m[:, 149] = 0
    m[199] = 0
    m[199, 149] = 1
    m[m.sum(1) == 0, 0] = 1
    p = np.sqrt(m / m.sum(1, keepdims=True))
    dots = p @ p.T
    dist = np.where(dots > 0, np.sqrt(np.maximum(1 - dots, 0)), np.inf)
    names = [f"r{i:03d}" for i in range(200)]
    bag = triples(spark, m).withColumn("row_id", F.format_string("r%03d", "row_id"))
    got = found(neighbors.knn_hellinger(bag, 4))
    want = {names[i]: [names[j] for _, j in v] for i, v in brute(dist, 4, 9).items() if v}
    assert "r199" not in got
    assert {i: [j for _, j in v] for i, v in got.items()} == want


def test_blocks_are_pruned(spark, clumpy):
    rows = neighbors.unit_vectors(matrix_rows(spark, clumpy))
    sample = rows.orderBy(F.xxhash64("id")).limit(6).toPandas()
    pivots = neighbors._signatures(sample, False)
    blocks = neighbors.cut(
        neighbors._pack(neighbors._assign(rows, pivots, False), "cosine", 5, False, 16)
    )
    tops = {r["cell"]: r["h"] for r in blocks.groupBy("cell").agg(F.max("hi").alias("h")).collect()}
    n = blocks.count()
    assert neighbors._tiles(blocks, pivots, tops).count() < n * (n - 1) / 2 / 2


def test_truncated_svd(spark):
    rng = np.random.default_rng(1)
    # Five strong directions over weak noise, as the randomised method assumes.
    m = rng.random((60, 5)) * [16, 8, 4, 2, 1] @ (rng.random((5, 30)) < 0.4)
    m = m + 0.01 * rng.random((60, 30)) * (rng.random((60, 30)) < 0.3)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    got = dense(reduce.truncated_svd(triples(spark, m), 5), 60)
    want = u[:, :5] * s[:5]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4)
    assert (got[np.argmax(np.abs(got), axis=0), np.arange(5)] > 0).all()


def test_svd_in_tiles_equals_svd_in_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = np.abs(rng.standard_normal((40, 25))) * (rng.random((40, 25)) < 0.4)
    one = dense(reduce.truncated_svd(triples(spark, m), 3), 40)
    monkeypatch.setattr(reduce, "BLOCK_CELLS", 64)
    many = dense(reduce.truncated_svd(triples(spark, m), 3), 40)
    assert np.allclose(one, many, atol=1e-7)


def test_rows_of_the_sketch_meet_each_slab_once(spark, monkeypatch):
    """Rows lie in one slab, long ones are dealt by column, and products come out whole."""
    rng = np.random.default_rng(3)
    m = np.abs(rng.standard_normal((40, 25))) * (rng.random((40, 25)) < 0.2)
    m[7] = 1.0
    sketch = spark.createDataFrame([(f"c{j}", [1.0, float(j)]) for j in range(25)], "id string, vec array<double>")
    for cells, split in ((30, False), (10, True)):
        monkeypatch.setattr(reduce, "BLOCK_CELLS", 2 * cells)
        matrix = reduce.TripleMatrix(triples(spark, m), 2)
        assert matrix.slabs > 4 and matrix.split == split
        want = m @ np.stack((np.ones(25), np.arange(25.0)), axis=1)
        held = matrix._product(sketch, "cols", "rows").count()
        assert held == (m.any(axis=1)).sum() or split
        got = {r["id"]: r["vec"] for r in matrix.times(sketch).collect()}
        folded = {r["id"]: r["vec"] for r in matrix.folded_times(sketch).collect()}
        assert len(got) == m.any(axis=1).sum() and len(folded) == 25
        for j in range(25):
            assert np.allclose(folded[f"c{j}"], (m.T @ want)[j])
        assert np.allclose(sorted(map(tuple, got.values())), sorted(map(tuple, want[m.any(axis=1)])))


def test_slabs_are_multiplied_in_waves(spark, monkeypatch):
    """Products, also of long rows, are those of one wave, and no table but the result is left."""
    rng = np.random.default_rng(6)
    m = np.abs(rng.standard_normal((40, 25))) * (rng.random((40, 25)) < 0.2)
    m[7] = 1.0
    m[~m.any(axis=1), 0] = 1.0
    want = [dense(reduce.truncated_svd(triples(spark, m), 3, power=1), 40)]
    want.append({r["id"]: r["vec"] for r in reduce.item_vectors(triples(spark, m), 3, power=1).collect()})
    cut, written = reduce.cut, []
    monkeypatch.setattr(reduce, "cut", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(reduce, "WAVE_CELLS", 13 * 70)
    for cells, split in ((30, False), (10, True)):
        monkeypatch.setattr(reduce, "BLOCK_CELLS", 13 * cells)
        matrix = reduce.TripleMatrix(triples(spark, m), 13)
        assert len(matrix.waves) > 2 and matrix.split == split
        del written[:]
        assert np.allclose(dense(reduce.truncated_svd(triples(spark, m), 3, power=1), 40), want[0], atol=1e-7)
        got = {r["id"]: r["vec"] for r in reduce.item_vectors(triples(spark, m), 3, power=1).collect()}
        assert got.keys() == want[1].keys() and all(np.allclose(got[c], want[1][c], atol=1e-6) for c in got)
        left = [t for t in written if getattr(t, "_cut_path", None)]
        assert len(written) > 15 and len(left) == (4 if split else 2)  # results, and the sizes of long rows


def test_folded_vectors_equal_explicit_product(spark):
    rng = np.random.default_rng(4)
    m = np.abs(rng.standard_normal((50, 20))) * (rng.random((50, 20)) < 0.3)
    bag = triples(spark, m)
    table = cooccurrence.bag_cooccurrence(bag, block=6, slab=40)
    c = np.diag(m.sum(0)) @ m.T @ m
    got = {(r["c1"], r["c2"]): r["w"] for r in table.collect()}
    for i in range(20):
        for j in range(20):
            assert got.get((f"c{i}", f"c{j}"), 0.0) == pytest.approx(c[i, j], abs=1e-9)
    folded = {r["id"]: r["vec"] for r in reduce.item_vectors(bag, 4, power=4).collect()}
    direct = {r["id"]: r["vec"] for r in reduce.token_vectors(table, 4).collect()}
    u, s, _ = np.linalg.svd(c)
    for i in range(20):
        if f"c{i}" in folded:
            assert np.allclose(np.abs(folded[f"c{i}"]), np.abs(u[i, :4] * s[:4]), rtol=1e-3, atol=1e-3)
            assert np.allclose(folded[f"c{i}"], direct[f"c{i}"], rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("folded", [False, True])
def test_small_components_are_found(spark, folded):
    """Each direction half as strong as the one before, down to rounding."""
    rng = np.random.default_rng(7)
    left, right = (np.linalg.qr(rng.standard_normal((n, 60)))[0] for n in (200, 60))
    m = left * 0.5 ** np.arange(60) @ right.T
    bag = triples(spark, m)
    if folded:
        table, whole = reduce.item_vectors(bag, 40), np.diag(m.sum(0)) @ m.T @ m
        rows = {r["id"]: r["vec"] for r in table.collect()}
        got = np.array([rows[f"c{j}"] for j in range(60)])
    else:
        got, whole = dense(reduce.truncated_svd(bag, 40), 200), m
    u, s, _ = np.linalg.svd(whole)
    assert np.allclose(np.linalg.norm(got, axis=0), s[:40], rtol=1e-2, atol=1e-14 * s[0])
    clear = s[:40] > 1e-11 * s[0]
    assert clear.sum() > (15 if folded else 35)
    error = np.linalg.norm(np.abs(got) - np.abs(u[:, :40] * s[:40]), axis=0)
    assert (error[clear] < 1e-2 * s[:40][clear]).all()


def test_svd_of_nothing_and_of_low_rank(spark):
    none = spark.createDataFrame([], "row_id long, col_id string, w double")
    assert reduce.truncated_svd(none, 3).count() == 0
    m = np.outer(np.arange(1.0, 9), np.arange(1.0, 6))
    got = dense(reduce.truncated_svd(triples(spark, m), 4), 8)
    assert np.allclose(got[:, 0], np.arange(1.0, 9) * np.sqrt(55)) and np.allclose(got[:, 1:], 0, atol=1e-9)


def test_compress_and_pca(spark):
    rng = np.random.default_rng(6)
    m = rng.standard_normal((80, 10)) * np.array([9, 5, 3, 1, 1, 1, 1, 1, 1, 1.0]) + 2
    got = dense(reduce.compress(matrix_rows(spark, m), 3), 80)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-3)
    centred = m - m.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    flat = {r["id"]: (r["x"], r["y"]) for r in reduce.pca_start(matrix_rows(spark, m)).collect()}
    flat = np.array([flat[i] for i in range(80)])
    assert np.allclose(np.abs(flat), np.abs(u[:, :2] * s[:2]), atol=1e-6)


@pytest.fixture(scope="module")
def transport_case(spark):
    rng = np.random.default_rng(8)
    items = rng.standard_normal((30, 4))
    m = rng.integers(0, 4, (20, 30)) * (rng.random((20, 30)) < 0.4)
    m[m.sum(1) == 0, 0] = 1
    m[7] = m[3]
    m[8] = 5 * m[3]
    vectors = spark.createDataFrame(
        [(f"c{j}", [float(v) for v in items[j]]) for j in range(30)], "id string, vec array<double>"
    )
    bag = triples(spark, m).cache()
    cloud = transport.reference_cloud(bag, vectors, 5)
    return bag, vectors, cloud


def test_transport_properties(spark, transport_case):
    bag, vectors, cloud = transport_case
    rows = dense(transport.transport_rows(bag, vectors, cloud), 20)
    assert np.allclose(rows[7], rows[3]) and np.allclose(rows[8], rows[3])
    assert not np.allclose(rows[3], rows[4])
    itself = spark.createDataFrame(
        [(0, f"z{k}", float(r)) for k, r in enumerate(cloud.mass)],
        "row_id long, col_id string, w double",
    )
    points = spark.createDataFrame(
        [(f"z{k}", [float(v) for v in z]) for k, z in enumerate(cloud.points)],
        "id string, vec array<double>",
    )
    home = dense(transport.transport_rows(itself, points, cloud), 1)
    assert np.linalg.norm(home) < 0.5 * np.linalg.norm(rows, axis=1).mean()


def test_giant_bags_solved_across_tasks_agree(spark, transport_case):
    bag, vectors, cloud = transport_case
    small = dense(transport.transport_rows(bag, vectors, cloud, iterations=6), 20)
    large = dense(transport.transport_rows(bag, vectors, cloud, iterations=6, bag_entries=12), 20)
    assert np.allclose(small, large, atol=1e-8)


def test_every_token_has_a_vector(spark):
    """Tokens that only end a line, or stand alone, come back as well."""
    lines = [["run", "a"], ["run", "b"], ["run", "c", "d"], ["alone"], ["run", "a"]]
    tokens = spark.createDataFrame([(t,) for t in lines], "tokens array<string>")
    found = {r["id"]: r["vec"] for r in vector_queries.token_vectors_of(tokens, 3, 1).collect()}
    assert set(found) == {"run", "a", "b", "c", "d", "alone"}
    assert found["alone"] == [0.0] * 3
    assert all(any(abs(v) > 1e-9 for v in found[t]) for t in ("a", "b", "c", "d"))


@pytest.mark.parametrize("n", [1, 2, 6])
def test_cloud_of_few_nearly_equal_points(spark, n):
    points = [(i, [1.0 + 1e-12 * i, float(i % 2)]) for i in range(n)]
    items = spark.createDataFrame(points, "id long, vec array<double>")
    bag = spark.createDataFrame([(r, i, 1.0 + r) for r in range(3) for i in range(n)], "row_id long, col_id long, w double")
    cloud = transport.reference_cloud(bag, items, 32)
    assert len(cloud.mass) == min(n, 2) and abs(cloud.mass.sum() - 1) < 1e-12
    assert transport.transport_embedding(bag, items, 32, 4).count() == 3


def test_mass_without_vector(spark):
    bag = spark.createDataFrame([("r", "a", 3.0), ("r", "b", 1.0), ("s", "a", 2.0)], "row_id string, col_id string, w double")
    items = spark.createDataFrame([("a", [1.0])], "id string, vec array<double>")
    lost = {r["row_id"]: r["lost"] for r in transport.mass_without_vector(bag, items).collect()}
    assert lost == {"r": 0.25, "s": 0.0}


def test_descent_finds_nearly_all_neighbours(spark):
    rng = np.random.default_rng(8)
    m = rng.standard_normal((1200, 16)) + 2 * rng.standard_normal((30, 16))[rng.integers(0, 30, 1200)]
    m[50:90] = m[50]
    rows = matrix_rows(spark, m)
    near = lambda df: {(r["id"], r["neighbor"]) for r in df.collect()}
    unit = neighbors.unit_vectors(rows)
    exact = near(neighbors.knn_cosine(rows, 10))
    first = near(neighbors._inside_blocks(neighbors.cut(unit), 10, 64, 1200))
    found = near(neighbors.nearest_with_copies(unit, "cosine", 10, search=lambda u: neighbors.descend(u, 10, block_rows=64)))
    assert len(found) == len(exact)
    assert len(found & exact) >= 0.95 * len(exact) > len(first & exact)


def test_descent_of_few_rows(spark):
    for n in (0, 1, 2, 5):
        rows = matrix_rows(spark, np.eye(6)[:n] + 0.1) if n else spark.createDataFrame([], "id long, vec array<double>")
        exact = sorted(map(tuple, neighbors.knn_cosine(rows, 3).select("id", "neighbor", "dist").collect()))
        assert sorted(map(tuple, neighbors.knn_cosine(rows, 3, exact=False).select("id", "neighbor", "dist").collect())) == exact


def test_transport_with_next_to_no_entropy():
    """A cloud of one point takes all mass, whatever rounding leaves of its cost to itself."""
    rng = np.random.default_rng(9)
    vec = rng.standard_normal((12, 3)) * 5
    w = rng.random(12)
    cloud = transport.Cloud(vec.mean(axis=0)[None], np.ones(1), 3e-18)
    got = transport._solve_batch(w, vec, np.array([0, 5]), cloud, 50)
    for row, part in zip(got, (slice(0, 5), slice(5, 12))):
        assert np.allclose(row, np.average(vec[part], axis=0, weights=w[part]) - cloud.points[0])

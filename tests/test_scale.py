"""Work that must grow with the rows: few copies of entries travel, results stay whole."""

import numpy as np
from pyspark.sql import functions as F

from telemap.operators import cooccurrence


def _bag(spark, n_rows: int, n_cols: int, seed: int):
    """Bag of rows of very different length, and the same as a matrix."""
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((n_rows, n_cols)) < rng.random((n_rows, 1)) ** 2, rng.integers(1, 5, (n_rows, n_cols)), 0)
    r, c = np.nonzero(m)
    rows = [(int(i), f"c{j:02d}", float(m[i, j])) for i, j in zip(r, c)]
    return spark.createDataFrame(rows, "row_id long, col_id string, w double"), m


def test_short_rows_make_their_pairs_without_tiles(spark, monkeypatch):
    bag, m = _bag(spark, 40, 30, 3)
    want = m.sum(axis=0)[:, None] * (m.T @ m)

    def check(table):
        got = np.zeros_like(want, dtype=float)
        for row in table.collect():
            got[int(row["c1"][1:]), int(row["c2"][1:])] += row["w"]
        assert np.allclose(got, want)

    tiled = cooccurrence._tiled_products
    seen = []
    monkeypatch.setattr(cooccurrence, "_tiled_products", lambda *a: seen.append(a[0].count()) or tiled(*a))
    check(cooccurrence.bag_cooccurrence(bag, block=6, slab=40))
    assert seen == []
    check(cooccurrence.bag_cooccurrence(bag, block=6, slab=40, short=8))
    sizes = (m > 0).sum(axis=1)
    assert seen == [sizes[sizes > 8].sum()]


def _smoothed(lines: list[list[str]], n_iter: int, radius: int, harmonic: bool) -> dict:
    """The definition, place by place."""
    weight = lambda d: 1.0 / d if harmonic else 1.0
    places = [(line[i], d, line[i + d], (n, i)) for n, line in enumerate(lines) for i in range(len(line)) for d in range(1, radius + 1) if i + d < len(line)]
    table: dict = {}
    for c1, d, c2, _ in places:
        table[c1, c2] = table.get((c1, c2), 0.0) + weight(d)
    for _ in range(n_iter):
        total: dict = {}
        for (c1, _c2), w in table.items():
            total[c1] = total.get(c1, 0.0) + w
        z = [weight(d) * table[c1, c2] / total[c1] for c1, d, c2, _ in places]
        window: dict = {}
        for (*_, at), v in zip(places, z):
            window[at] = window.get(at, 0.0) + v
        table = {}
        for (c1, _d, c2, at), v in zip(places, z):
            table[c1, c2] = table.get((c1, c2), 0.0) + v / window[at]
    return table


def test_smoothing_by_first_token_equals_its_definition(spark, monkeypatch):
    rng = np.random.default_rng(5)
    lines = [[f"w{int(v)}" for v in rng.zipf(1.6, n) % 12] for n in rng.integers(0, 40, 30)] + [["w1", "w2"] * 20] * 3
    df = spark.createDataFrame([(line,) for line in lines], "tokens array<string>").repartition(3)
    monkeypatch.setattr(cooccurrence, "CHUNK_WINDOWS", 16)
    for kernel in cooccurrence.KERNELS:
        want = _smoothed(lines, 2, 4, kernel == "harmonic")
        for limit in (10_000, 25):  # no token is cut into chunks; the frequent ones are
            table = cooccurrence.smooth_cooccurrence(df, n_iter=2, radius=4, kernel=kernel, limit=limit)
            got = {(r["c1"], r["c2"]): r["w"] for r in table.collect()}
            assert got.keys() == want.keys()
            assert all(abs(got[pair] - want[pair]) < 1e-9 for pair in want)


def test_windows_travel_packed(spark, monkeypatch):
    """Windows go to buckets as numbers; small tasks, buckets and sums give the same pairs."""
    rng = np.random.default_rng(7)
    lines = [[None if v == 9 else f"w{int(v)}" for v in rng.zipf(1.5, n) % 14] for n in rng.integers(0, 40, 30)] + [["w1"], []]
    df = spark.createDataFrame([(line,) for line in lines], "tokens array<string>").repartition(3)
    want: dict = {}
    for line in lines:
        for i, c1 in enumerate(line):
            for d, c2 in enumerate(line[i + 1 : i + 5], 1):
                if c1 is not None and c2 is not None:
                    one, two = want.get((c1, c2), (0.0, 0.0))
                    want[c1, c2] = one + 1.0, two + 1.0 / d
    for windows, limit in ((1_000_000, 500_000), (20, 500_000), (20, 25)):
        monkeypatch.setattr(cooccurrence, "PACK_WINDOWS", windows)
        monkeypatch.setattr(cooccurrence, "BUCKET_WINDOWS", windows)
        table = cooccurrence.windowed_cooccurrence(df, radius=4, kernel=cooccurrence.KERNELS, limit=limit)
        assert "hashpartitioning(t0_bucket" in table._jdf.queryExecution().executedPlan().toString()
        rows = [r for r in table.collect() if r["c1"] is not None]
        got = {(r["c1"], r["c2"]): (r["flat"], r["harmonic"]) for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys()
        assert all(np.allclose(got[pair], want[pair]) for pair in want)


def test_a_chunk_is_told_of_its_own_pairs_only(spark, monkeypatch):
    """A token with many windows and many partners: no row holds all of its pairs."""
    lines = [["a", f"x{i}", "a", f"y{i}"] for i in range(60)]
    df = spark.createDataFrame([(line,) for line in lines], "tokens array<string>").repartition(3)
    monkeypatch.setattr(cooccurrence, "CHUNK_WINDOWS", 16)
    written, plans = cooccurrence.cut, []
    monkeypatch.setattr(cooccurrence, "cut", lambda t: (plans.append(t._jdf.queryExecution().toString()), written(t))[1])
    table = cooccurrence.smooth_cooccurrence(df, n_iter=2, radius=3, limit=25)
    got, want = {(r["c1"], r["c2"]): r["w"] for r in table.collect()}, _smoothed(lines, 2, 3, False)
    assert got.keys() == want.keys() and all(abs(got[pair] - want[pair]) < 1e-9 for pair in want)
    assert len(plans) > 3 and not any("collect_list" in plan for plan in plans)


def test_blocks_travel_in_groups(spark, monkeypatch):
    from telemap.operators import neighbors

    monkeypatch.setattr(neighbors, "LEAST_GROUPS", 3)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    groups = neighbors._groups
    counts = []

    def seen(blocks, columns, most):
        found = groups(blocks, columns, most)
        counts.append((blocks.count(), found[0].count()))
        return found

    monkeypatch.setattr(neighbors, "_groups", seen)
    got = {(r["id"], r["rank"]): r["neighbor"] for r in neighbors.nearest_rows(df, "cosine", 4, 16).collect()}
    dist = np.round(1 - x @ x.T, 12)
    np.fill_diagonal(dist, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(300), dist.shape), dist))[:, :4]
    assert got == {(i, j + 1): int(want[i, j]) for i in range(300) for j in range(4)}
    assert all(n_groups < n_blocks for n_blocks, n_groups in counts)


def test_pairs_within_bounds_are_those_of_the_whole_matrix(monkeypatch):
    from telemap.operators import neighbors

    rng = np.random.default_rng(2)
    dist = np.round(rng.random((40, 60)), 2) + rng.random((40, 60)) * 1e-12
    for bound in (np.full(40, 0.05), np.full(40, 0.9), np.full(40, np.inf)):
        ranked = []
        whole = neighbors._nearest
        want = whole(np.round(dist, 9), 5, bound)
        monkeypatch.setattr(neighbors, "_nearest", lambda *a: ranked.append(1) or whole(*a))
        got = neighbors._nearest_within(dist, 5, bound, 9)
        monkeypatch.setattr(neighbors, "_nearest", whole)
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
        assert bool(ranked) == (bound[0] > 0.5)


def test_a_warm_map_seeks_neighbours_once(spark, monkeypatch):
    from telemap.operators import neighbors
    from telemap.plans import vector_queries

    calls = []
    nearest = neighbors.nearest_rows
    monkeypatch.setattr(neighbors, "nearest_rows", lambda *a, **kw: calls.append(1) or nearest(*a, **kw))
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>")
    monkeypatch.setattr(vector_queries, "embedding_vectors", lambda *a: vectors)
    flat = [F.lit(0.0).alias(c) for c in "xy"]
    monkeypatch.setattr(vector_queries.layout, "data_map", lambda rows, *a: rows.select("id", *flat))
    assert vector_queries.map_warm(spark, "").count() == 60
    assert len(calls) == 1


def test_weighted_bag_with_common_columns_in_place(spark, monkeypatch):
    from telemap.operators import weights

    bag, _ = _bag(spark, 30, 20, 8)
    bag = bag.select("row_id", "col_id", F.col("w").cast("long").alias("n"))
    bag = bag.unionByName(spark.createDataFrame([(None, "c00", 3), (None, "c01", 2)], bag.schema))
    key = lambda r: (r["row_id"] is None, r["row_id"], r["col_id"])
    want = sorted(weights.reweight(bag, weights.information_weights(bag)).collect(), key=key)
    for common in (0, 4, 100):
        monkeypatch.setattr(weights, "COMMON", common)
        got = sorted(weights.information_bag(bag).collect(), key=key)
        assert [key(r) for r in got] == [key(r) for r in want]
        assert np.allclose([r["w"] for r in got], [r["w"] for r in want])


def test_tokens_of_documents_are_not_shuffled(spark):
    from telemap.plans import bag_queries, inputs

    small = "/root/testdata/sf0.001"
    for table in (inputs.document_bag(spark, small), bag_queries.ngram_bag(spark, small)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1

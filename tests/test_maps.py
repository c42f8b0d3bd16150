"""Layout, clusters and alignment on shapes with a known answer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from telemap.operators import cluster, layout, maps, neighbors
from telemap.plans import all_queries


def points_df(spark, xy):
    return spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double"
    )


def test_fuzzy_graph(spark):
    rng = np.random.default_rng(0)
    knn = neighbors.knn_plane(points_df(spark, rng.standard_normal((80, 2))), 15).cache()
    near = {}
    for r in knn.collect():
        near.setdefault(r["id"], []).append((r["dist"], r["neighbor"]))
    directed = {}
    for i, pairs in near.items():
        ds = np.array([d for d, _ in pairs])
        rho = ds[ds > 0].min()
        lo, hi, mid = 0.0, math.inf, 1.0
        for _ in range(64):
            if np.exp(-np.maximum(ds - rho, 0) / mid).sum() > math.log2(15):
                hi = mid
            else:
                lo = mid
            mid = lo * 2 if hi == math.inf else (lo + hi) / 2
        for d, j in pairs:
            directed[i, j] = math.exp(-max(d - rho, 0) / mid)
    got = layout.fuzzy_graph(knn, 15).collect()
    assert all(0 < r["w"] <= 1 + 1e-12 and r["a"] < r["b"] for r in got)
    for r in got:
        p, q = directed.get((r["a"], r["b"]), 0.0), directed.get((r["b"], r["a"]), 0.0)
        assert r["w"] == pytest.approx(p + q - p * q, abs=1e-9)


def test_layout_keeps_neighbours_and_repeats(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((4, 10)) * 5
    m = np.concatenate([c + 0.5 * rng.standard_normal((40, 10)) for c in centres])
    rows = spark.createDataFrame(
        [(i, [float(v) for v in m[i]]) for i in range(len(m))], "id long, vec array<double>"
    )
    first = {r["id"]: (r["x"], r["y"]) for r in layout.map_vectors(rows, epochs=12).collect()}
    again = {r["id"]: (r["x"], r["y"]) for r in layout.map_vectors(rows, epochs=12).collect()}
    assert all(abs(first[i][0] - again[i][0]) < 1e-6 for i in first)
    xy = np.array([first[i] for i in range(len(m))])
    assert np.isfinite(xy).all()
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    same = (near // 40 == np.arange(len(m))[:, None] // 40).mean()
    assert same > 0.9


def blobs(seed=2):
    rng = np.random.default_rng(seed)
    return np.concatenate(
        [
            rng.normal([0, 0], 0.2, (30, 2)),
            rng.normal([10, 0], 0.2, (30, 2)),
            np.array([[5, 30], [-30, 5], [40, -20], [0, -40], [-25, -30]]),
        ]
    )


@pytest.mark.parametrize("select", ["eom", "leaf"])
def test_blobs_are_found_and_strays_are_noise(spark, select):
    got = cluster.density_clusters(points_df(spark, blobs()), 10, 12, select)
    labels = {r["id"]: r["cluster"] for r in got.collect()}
    one = [labels[i] for i in range(30)]
    two = [labels[i] for i in range(30, 60)]
    core = max(set(one), key=one.count), max(set(two), key=two.count)
    assert core[0] != core[1] and min(core) >= 0
    if select == "eom":
        assert one.count(core[0]) >= 27 and two.count(core[1]) >= 27
    assert sum(labels[i] == -1 for i in range(60, 65)) >= 4


def test_unplaced_points_are_in_no_cluster(spark):
    points = points_df(spark, blobs())
    lost = spark.createDataFrame([(100, None, None), (101, None, None)], points.schema)
    got = cluster.density_clusters(points.union(lost), 10, 12).collect()
    assert sorted(got) == sorted(cluster.density_clusters(points, 10, 12).collect())
    assert {r["id"] for r in got} == set(range(65))


@pytest.mark.parametrize("name", ["density_clusters", "leaf_clusters", "map_warm"])
def test_cluster_and_warm_queries_use_a_whole_map(spark, monkeypatch, name):
    """All rows, all dimensions, by the library's layout."""
    seen = []

    def short(vectors, start=None):
        seen.append((vectors, start))
        return whole(vectors, epochs=1, start=start)

    whole = layout.map_vectors
    monkeypatch.setattr(layout, "map_vectors", short)
    got = all_queries()[name](spark, SMALL)
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert got.count() == rows.count() == got.select("id").distinct().count()
    vectors, start = seen[-1]
    assert vectors.agg(F.min(F.size("vec"))).first()[0] == len(rows.first()["embedding"])
    if name == "map_warm":
        assert start.filter("x IS NOT NULL AND y IS NOT NULL").count() == rows.count()


def test_components(spark):
    edges = spark.createDataFrame(
        [(1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (8, 9), (20, 21)], "a long, b long"
    )
    got = {r["v"]: r["c"] for r in cluster.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def test_procrustes_recovers_a_turned_copy(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((50, 2))
    turn = np.array([[math.cos(1.1), -math.sin(1.1)], [math.sin(1.1), math.cos(1.1)]])
    b = 3.7 * a @ turn.T @ np.diag([1, -1]) + [5, -2]
    rows = maps.procrustes(points_df(spark, a), points_df(spark, b)).collect()
    assert max(abs(r["x1"] - r["x2"]) + abs(r["y1"] - r["y2"]) for r in rows) < 1e-9
    assert np.allclose(
        sorted(r["x1"] for r in rows), sorted(a[:, 0] - a[:, 0].mean()), atol=1e-9
    )


def test_unplaced_rows_stay_null(spark):
    bag = spark.createDataFrame(
        [(i, t, 1.0) for i in range(20) for t in (f"t{i % 3}", "shared")] + [(99, "alone", 1.0)],
        "row_id long, col_id string, w double",
    )
    placed = layout.map_bags(bag, k=5, epochs=3)
    seen = maps.placement(placed).first()
    assert seen["any_unplaced"] and seen["n_placed"] == 20 and seen["n_points"] == 21
    assert placed.filter(F.col("x").isNull()).first()["id"] == 99

"""Hard negatives: SQL, brute force on odd tables, the curve and the bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import differences
from telemap.llm import negatives as H

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, block long, tile string, score double"


def brute(rows, every=10, positives=5, negatives=5, low=80, high=100):
    width = max((len(v) for _, v, _ in rows if v), default=0)
    ready = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ready.append((i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (width - len(v)), label))
    anchors = {}
    for i, v, label in ready:
        if i % every == 0 and (i not in anchors or label < anchors[i][1]):
            anchors[i] = (v, label)
    out = []
    for a, (va, la) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in ready if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fits = [x for x in scored if x[2] != la and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, width=6, labels=3):
    r = random.Random(seed)
    near = [[r.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = r.randrange(labels)
        out.append((i, [float(np.float32(x + r.gauss(0, 0.6))) for x in near[label]], label if r.random() > 0.2 else r.randrange(labels)))
    return out


def odd_vectors():
    rows = vectors(1, 260)
    rows += [(1000, None, 1), (1010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1020, [float("nan")] + [0.0] * 5, 2)]
    rows += [(1030, [float("inf")] + [0.0] * 5, 2), (1040, [0.5] * 6, None), (None, [0.5] * 6, 1), (1050, [], 0), (1060, [1.0, 2.0], 0)]
    rows += [(1070, [0.0] * 6, 0), (1080, [-1.0] * 6, 1), (20, rows[20][1], 2), (21, rows[21][1], rows[21][2]), (40, rows[40][1], rows[40][2])]
    rows += [(2000 + k, rows[30][1], rows[30][2] if k % 2 else 1) for k in range(40)]  # copies and ties
    return rows


def mined(spark, rows, **how):
    table = spark.createDataFrame([(i, v, label, 1, "x", 0.5) for i, v, label in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine_negatives(table.repartition(3), F.expr("vec_id % 10 = 0"), **how).collect())


@pytest.mark.parametrize("block,zone,tile", [(512, 32, 1024), (7, 3, 5)])
def test_odd_tables_meet_brute_force(spark, monkeypatch, block, zone, tile):
    for name, value in (("BLOCK", block), ("ZONE", zone), ("TILE", tile)):
        monkeypatch.setattr(H, name, value)
    rows = odd_vectors()
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=3, negatives=2, low=50, high=95) == brute(rows, 10, 3, 2, 50, 95)


def test_large_components_are_exact(spark):
    r = random.Random(4)
    rows = [(i, [float(np.float32(r.gauss(0, 4e4))) for _ in range(8)], i % 2) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [2.0], 1)]) == []
    assert mined(spark, [(10, [], 0), (11, [], 0), (12, [], 1)]) == [(10, 11, 1, 12, 0, 0)]


def test_query_meets_sql(spark):
    assert differences(spark, SMALL, "op13_negatives") == []


def test_curve_visits_neighbours():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(H.hilbert_keys(cells, 3))
    assert sorted(H.hilbert_keys(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    r = np.random.default_rng(3)
    a, b = r.integers(-300, 300, (20, 9)), r.integers(-300, 300, (50, 9))
    lower, upper = H.interval(a, b.min(axis=0)[None], b.max(axis=0)[None], 300)
    score = a @ b.T
    assert (lower <= score).all() and (score <= upper).all()

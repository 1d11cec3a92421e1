"""Neighbours and regions against all pairs by great-circle distance."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from quernel.operators.spatial import KdTree, near_and_within


def _km(a, b) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_tree_pairs():
    xyz = np.random.default_rng(1).normal(size=(700, 3))
    xyz[:60] = xyz[0]
    tree = KdTree(xyz)
    got = [tuple(sorted(p)) for i, j in tree.close_pairs(0.3) for p in zip(i.tolist(), j.tolist())]
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 0.3)) if i < j}
    assert len(got) == len(set(got)) and set(got) == want
    reach = np.linspace(0, 3, 9)
    got = {p for c, q in tree.around(xyz[:9], reach) for p in zip(c.tolist(), q.tolist())}
    assert got == {(c, p) for c in range(9) for p in range(700) if d[c, p] <= reach[c]}


@pytest.mark.parametrize(("cell", "block"), [(25, 10**6), (60, 20), (10**6, 10**6)])
def test_near_and_within(spark, cell, block):
    draw = random.Random(3)
    spots = [(89.999, 10.0), (-89.9995, 0.0), (10.0, 180.0), (10.0, -179.9995), (48.0, 2.0)]
    points = [(i, *(s + draw.gauss(0, 0.001) for s in draw.choice(spots))) for i in range(250)]
    points = [(i, max(-90.0, min(90.0, a)), max(-180.0, min(180.0, b))) for i, a, b in points]
    points += [(300 + i, 48.0, 2.0) for i in range(40)] + [(400, None, 1.0), (401, float("nan"), 1.0), (402, 91.0, 1.0), (403, 0.0, 0.0), (None, 48.0, 2.0)]
    regions = [(1, 48.0, 2.0, 0.15), (2, 10.0, 180.0, 30000.0), (3, 89.9, 0.0, 15.0), (4, 48.0, 2.0, None), (5, 0.0, 0.0, 100.0), (6, -89.0, 5.0, -1.0)]
    frame = spark.createDataFrame(points + points[::9], "id long, lat double, lng double")
    held = spark.createDataFrame(regions + regions[:2], "id long, lat double, lng double, radius_km double")
    got = [tuple(r) for r in near_and_within(frame, held, 0.2, cell, block).collect()]
    ok = [(i, (a, b)) for i, a, b in points if i is not None and a is not None and abs(a) <= 90 and not (a == 0 and b == 0)]
    want = {("near", i, j) for i, a in ok for j, b in ok if i < j and _km(a, b) <= 0.2}
    want |= {("bucket", i, n) for i, a in ok for n, x, y, r in regions[:3] if _km(a, (x, y)) <= r}
    assert len(got) == len(set(got)) and set(got) == want


def test_nothing(spark):
    none = spark.createDataFrame([], "id long, lat double, lng double")
    assert near_and_within(none, None, 0.2).count() == 0

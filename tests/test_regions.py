"""Points in polygons and boxes against plain ray casting, also over the poles and the 180th meridian."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quernel.operators.regions import box_ring, regions_of


def _inside(lat: float, lng: float, ring: list[tuple[float, float]]) -> bool:
    """The ring laid out from its first corner on, and the point put on it at every turn."""
    lng = -180.0 if lng == 180 else lng
    unrolled = [ring[0]]
    for y, x in [*ring[1:], ring[0]]:
        turn = (x - unrolled[-1][1] + 540) % 360 - 180
        unrolled.append((y, unrolled[-1][1] + (180.0 if turn == -180 else turn)))
    above = 0
    for (ay, ax), (by, bx) in zip(unrolled, unrolled[1:]):
        for k in range(-4, 5):
            x = lng + 360 * k
            if min(ax, bx) <= x < max(ax, bx) and ay + (by - ay) * (x - ax) / (bx - ax) > lat:
                above += 1
    round_the_globe = abs(unrolled[-1][1] - unrolled[0][1]) > 180
    return (above % 2 == 1) != (round_the_globe and sum(y for y, _ in ring) >= 0)


def _star(draw: random.Random, lat: float, lng: float, size: float) -> list[tuple[float, float]]:
    turns = sorted(draw.random() * 2 * math.pi for _ in range(draw.randint(3, 9)))
    return [(max(-89.9, min(89.9, lat + size * draw.uniform(0.3, 1) * math.sin(t))), (lng + size * draw.uniform(0.3, 1) * math.cos(t) + 180) % 360 - 180) for t in turns]


@pytest.mark.parametrize(("slab", "block"), [(20_000, 100_000), (40, 100_000), (60, 7)])
def test_regions_of(spark, slab, block):
    draw = random.Random(11)
    spots = [(48.0, 2.0), (10.0, 179.0), (-60.0, -178.0), (85.0, 30.0), (-85.0, 100.0), (0.0, 0.0)]
    rings = [(i, _star(draw, *draw.choice(spots), draw.choice([1.0, 5.0, 30.0]))) for i in range(30)]
    rings += [(100, [(70.0, float(x)) for x in range(-180, 180, 40)]), (101, [(-75.0 - x % 3, float(x)) for x in range(170, -190, -40)]), (102, [(5.0, 5.0), (6.0, 6.0)]), (0, _star(draw, 48.0, 2.0, 5.0))]
    points = [(i, max(-90.0, min(90.0, a + draw.gauss(0, 8))), (o + draw.gauss(0, 8) + 180) % 360 - 180) for i, (a, o) in enumerate(draw.choices(spots, k=500))]
    points += [(600 + i, 48.0, 2.0) for i in range(40)] + [(700, 90.0, 12.0), (701, -90.0, -5.0), (702, 12.0, 180.0), (703, 12.0, -180.0), (704, 0.0, 0.0)]
    odd = [(800, None, 1.0), (801, float("nan"), 1.0), (802, 91.0, 0.0), (None, 48.0, 2.0)]
    frame = spark.createDataFrame(points + odd + points[::7], "id long, lat double, lng double").withColumn("region", F.lit("clash"))
    held = spark.createDataFrame(rings + rings[:3] + [(900, None), (None, rings[0][1])], "id long, ring array<struct<lat: double, lng: double>>")
    got = [tuple(r) for r in regions_of(frame, held, slab, block).collect()]
    want = {(i, n) for i, a, o in points for n, ring in rings if len(ring) > 2 and _inside(a, o, ring)}
    assert len(got) == len(set(got)) and set(got) == want
    assert {(700, 100), (701, 101)} <= want and not {(700, 101), (701, 100)} & want


def test_boxes(spark):
    boxes = [(1, -10.0, 170.0, 10.0, -170.0), (2, -90.0, -180.0, 90.0, 180.0), (3, 80.0, -200.0, 90.0, 160.0), (4, 0.0, 0.0, 1.0, 200.0), (5, 5.0, 5.0, 5.0, 9.0)]
    held = spark.createDataFrame(boxes, "id long, s double, w double, n double, e double").select("id", box_ring(*map(F.col, "swne")).alias("ring"))
    draw = random.Random(2)
    points = [(i, draw.uniform(-90, 90) if i % 2 else draw.uniform(-12, 12), draw.uniform(-180, 180)) for i in range(600)] + [(1000, -10.0, 170.0), (1001, 10.0, 175.0), (1002, 0.0, -170.0)]
    got = {tuple(r) for r in regions_of(spark.createDataFrame(points, "id long, lat double, lng double"), held).collect()}
    assert got == {(i, n) for i, a, o in points for n, s, w, t, e in boxes if s <= a < t and (o - w) % 360 < ((e - w) if e >= w else e - w + 360)}


def test_nothing(spark):
    none, ring = spark.createDataFrame([], "id long, lat double, lng double"), "id long, ring array<struct<lat: double, lng: double>>"
    one = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 9.0), (9.0, 0.0)])], ring)
    assert regions_of(none, one).count() == 0 and regions_of(spark.createDataFrame([(1, 1.0, 1.0)], none.schema), one.limit(0)).count() == 0

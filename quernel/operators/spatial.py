"""Points near points, and regions round points, anywhere on the globe.

Locations become unit vectors, so that a distance along the sphere is a chord
and neither the poles nor the 180th meridian are special. Space is cut by k-d
splits: into slabs of x, each into slabs of y, each into slabs of z, at
quantiles of all points. A point is owned by one cell; halo copies go to the
cells within its reach. Each cell then builds its own k-d tree and queries it
by chord radius, so there is one shuffle and no candidate pair crosses it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.session import ship

EARTH_KM = 6371.0
#: Cells at most; with more points than MAX_CELLS * cell_rows the cells grow, and are worked off in blocks.
MAX_CELLS = 8192
_LEAF = 24
_PAIRS = 4_000_000


def chord(km: Column | float) -> Column | float:
    """The straight line on the unit sphere under a great-circle distance."""
    if isinstance(km, Column):
        return 2 * F.sin(F.least(km, F.lit(math.pi * EARTH_KM)) / (2 * EARTH_KM))
    return 2 * math.sin(min(km, math.pi * EARTH_KM) / (2 * EARTH_KM))


def valid_location(lat: Column, lng: Column) -> Column:
    """A location counts if it is a number, in range and not the unset (0, 0)."""
    ok = lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)
    return ok & lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0))


def unit_vector(lat: Column, lng: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lng)
    return [(F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")]


class KdTree:
    """A balanced k-d tree as arrays, built and queried level by level without a Python loop over points."""

    def __init__(self, xyz: np.ndarray) -> None:
        n = len(xyz)
        self.depth = max(0, math.ceil(math.log2(max(1, n) / _LEAF)))
        order = np.arange(n)
        for level in range(self.depth):
            starts = self._starts(n, level)
            p = xyz[order]
            spread = np.maximum.reduceat(p, starts[:-1]) - np.minimum.reduceat(p, starts[:-1])
            node = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            order = order[np.lexsort((p[np.arange(n), np.argmax(spread, axis=1)[node]], node))]
        self.order, self.points = order, xyz[order]
        self.lo, self.hi = [], []
        for level in range(self.depth + 1):
            starts = self._starts(n, level)[:-1]
            self.lo.append(np.minimum.reduceat(self.points, starts))
            self.hi.append(np.maximum.reduceat(self.points, starts))
        self.leaves = self._starts(n, self.depth)

    @staticmethod
    def _starts(n: int, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * n >> level

    def close_pairs(self, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i, j), each unordered pair of two rows once, at most ``reach`` apart."""
        a = b = np.zeros(1, int)
        for level in range(self.depth):
            same = a == b
            l, r = 2 * a, 2 * b
            a, b = np.concatenate([l, l, l + 1, (l + 1)[~same]]), np.concatenate([r, r + 1, r + 1, r[~same]])
            lo, hi = self.lo[level + 1], self.hi[level + 1]
            gap = np.maximum(0, np.maximum(lo[a] - hi[b], lo[b] - hi[a]))
            keep = (gap * gap).sum(1) <= reach * reach
            a, b = a[keep], b[keep]
        size = np.diff(self.leaves)
        widest = int(size.max(initial=1))
        step = max(1, _PAIRS // (widest * widest))
        for k in range(0, len(a), step):
            u, v = a[k : k + step], b[k : k + step]
            cross = size[u] * size[v]
            pair = np.repeat(np.arange(len(u)), cross)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(cross) - cross, cross)
            i = self.leaves[u][pair] + at // size[v][pair]
            j = self.leaves[v][pair] + at % size[v][pair]
            keep = (u != v)[pair] | (i < j)
            i, j = i[keep], j[keep]
            d = self.points[i] - self.points[j]
            keep = (d * d).sum(1) <= reach * reach
            yield self.order[i[keep]], self.order[j[keep]]

    def around(self, centres: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (centre, point) with the point at most the centre's reach away."""
        for first in range(0, len(centres), 256):
            c = np.arange(first, min(first + 256, len(centres)))
            node = np.zeros(len(c), int)
            for level in range(self.depth + 1):
                lo, hi = self.lo[level][node], self.hi[level][node]
                gap = np.maximum(0, np.maximum(lo - centres[c], centres[c] - hi))
                keep = (gap * gap).sum(1) <= reach[c] ** 2
                c, node = c[keep], node[keep]
                if level < self.depth:
                    c, node = np.concatenate([c, c]), np.concatenate([2 * node, 2 * node + 1])
            size = np.diff(self.leaves)
            for k in range(0, len(c), step := max(1, _PAIRS // max(1, int(size.max(initial=1))))):
                m = size[node[k : k + step]]
                who = np.repeat(c[k : k + step], m)
                point = np.repeat(self.leaves[node[k : k + step]], m) + np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m)
                d = self.points[point] - centres[who]
                keep = (d * d).sum(1) <= reach[who] ** 2
                yield who[keep], self.order[point[keep]]


def _splits(points: DataFrame, cells: int) -> tuple[list[float], DataFrame]:
    """k-d splits at quantiles of all points: the bounds along x, and a row per (slab of x, slab of y) with the bounds along y and z.

    At most ``cells`` numbers come to the driver, from mergeable quantile summaries.
    """
    spark = points.sparkSession
    k = max(1, round(cells ** (1 / 3)))
    inner = [i / k for i in range(1, k)]
    if k == 1:
        return [], spark.createDataFrame([(0, 0, [], [])], "sx int, sy int, by array<double>, bz array<double>")
    xs = points.agg(F.percentile_approx("x", inner, 2000)).first()[0] or []
    slab = F.size(F.filter(F.array(*[F.lit(v) for v in xs]), lambda b: b <= F.col("x"))) if xs else F.lit(0)
    by = dict(points.groupBy(slab.alias("s")).agg(F.percentile_approx("y", inner, 2000)).collect())
    ys = [by.get(s, []) for s in range(k)]
    bounds = F.array(*[F.array(*[F.lit(v) for v in y]).cast("array<double>") for y in ys])
    second = points.withColumn("s", slab).withColumn("t", F.size(F.filter(F.element_at(bounds, F.col("s") + 1), lambda b: b <= F.col("y"))))
    bz = {(s, t): v for s, t, v in second.groupBy("s", "t").agg(F.percentile_approx("z", inner, 2000)).collect()}
    return xs, spark.createDataFrame([(s, t, ys[s], bz.get((s, t), [])) for s in range(k) for t in range(k)], "sx int, sy int, by array<double>, bz array<double>")


def _cells(rows: DataFrame, xs: list[float], splits: DataFrame) -> DataFrame:
    """``rows`` (x, y, z, reach) once per cell within reach, with ``cell`` and whether the cell owns the point."""
    at = lambda bounds, v: F.size(F.filter(F.col(bounds), lambda b: b <= v))
    span = lambda bounds, axis: F.sequence(at(bounds, F.col(axis) - F.col("reach")), at(bounds, F.col(axis) + F.col("reach")))
    k = len(xs) + 1
    by = F.broadcast(splits.where("sy = 0").select("sx", "by"))
    bz = F.broadcast(splits.select("sx", "sy", "bz"))
    rows = rows.withColumn("bx", F.array(*[F.lit(v) for v in xs]).cast("array<double>"))
    rows = rows.withColumn("ox", at("bx", F.col("x"))).withColumn("sx", F.explode(span("bx", "x"))).drop("bx").join(by, "sx")
    rows = rows.withColumn("oy", at("by", F.col("y"))).withColumn("sy", F.explode(span("by", "y"))).drop("by").join(bz, ["sx", "sy"])
    rows = rows.withColumn("oz", at("bz", F.col("z"))).withColumn("sz", F.explode(span("bz", "z"))).drop("bz")
    own = (F.col("ox") == F.col("sx")) & (F.col("oy") == F.col("sy")) & (F.col("oz") == F.col("sz"))
    return rows.withColumn("own", own).withColumn("cell", (F.col("sx") * k + F.col("sy")) * k + F.col("sz")).drop("ox", "oy", "oz", "sx", "sy", "sz")


def _query_cell(reach: float) -> object:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        regions = pdf["kind"].to_numpy() == 1
        points, centres = pdf[~regions], pdf[regions]
        kinds, left, right = [], [], []
        if len(points):
            ids, own, block = points["id"].to_numpy(), points["own"].to_numpy(), points["block"].to_numpy()
            here = {int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])}
            tree = KdTree(points[["x", "y", "z"]].to_numpy())
            for i, j in tree.close_pairs(reach) if reach >= 0 else ():
                first = np.where(ids[i] < ids[j], i, j)
                mine = own[first] & (ids[i] != ids[j])
                if len(here) == 2:
                    mine &= block[i] != block[j]
                kinds.append(np.full(int(mine.sum()), "near", object))
                left.append(np.minimum(ids[i], ids[j])[mine])
                right.append(np.maximum(ids[i], ids[j])[mine])
            if len(centres):
                for c, p in tree.around(centres[["x", "y", "z"]].to_numpy(), centres["reach"].to_numpy()):
                    mine = own[p]
                    kinds.append(np.full(int(mine.sum()), "bucket", object))
                    left.append(ids[p][mine])
                    right.append(centres["id"].to_numpy()[c][mine])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pd.DataFrame({"kind": join(kinds, object), "id": join(left, "int64"), "other_id": join(right, "int64")})

    return run


def near_and_within(points: DataFrame, regions: DataFrame | None, km: float | None, cell_rows: int = 20_000, block_rows: int = 100_000) -> DataFrame:
    """Pairs of points at most ``km`` apart, and the regions that hold each point.

    ``points`` has id BIGINT, lat, lng; ``regions`` (or None) has id, lat, lng
    and radius_km. Result: kind ('near' or 'bucket'), id, other_id; near pairs
    have the smaller id first and come once. Locations that are null, not a
    number, out of range or (0, 0) and rows without an id count nowhere; a
    region with a null or negative radius holds nothing. Repeated rows count
    once; a point id with several locations counts at the least (lat, lng), a
    region id with several at each. Empty inputs give no rows; other columns
    are ignored. ``km`` None asks for no near pairs.

    A cell that owns far more than its share (many points at one spot) is
    worked off in blocks: each pair of blocks is a task of its own, which keeps
    memory bounded where the pairs themselves must come out.
    """
    spark = points.sparkSession
    ship(spark)
    reach = -1.0 if km is None else chord(km)
    located = points.where(F.col("id").isNotNull() & valid_location(F.col("lat"), F.col("lng")))
    rows = located.groupBy("id").agg(F.min(F.struct("lat", "lng")).alias("p")).select("id", *unit_vector(F.col("p.lat"), F.col("p.lng")))
    spread = located.select(*unit_vector(F.col("lat"), F.col("lng")))
    total = spread.count()
    xs, splits = _splits(spread, min(MAX_CELLS, max(1, total // cell_rows)))

    sized = _cells(spread.withColumn("reach", F.lit(0.0)), xs, splits).where("own").groupBy("cell").count()
    crowded = [(c, -(-n // block_rows)) for c, n in sized.where(F.col("count") > block_rows).collect()]
    blocks = spark.createDataFrame(crowded or [(-1, 1)], "cell int, blocks int")

    placed = _cells(rows.withColumn("reach", F.lit(max(0.0, reach))), xs, splits).withColumn("kind", F.lit(0))
    if regions is not None:
        held = regions.where(F.col("id").isNotNull() & valid_location(F.col("lat"), F.col("lng")) & (F.col("radius_km") >= 0))
        held = held.select("id", *unit_vector(F.col("lat"), F.col("lng")), chord(F.col("radius_km")).alias("reach")).distinct()
        placed = placed.unionByName(_cells(held, xs, splits).withColumn("kind", F.lit(1)))
    placed = placed.join(F.broadcast(blocks), "cell", "left").fillna(1, ["blocks"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    mine = F.transform(others, lambda o: F.struct(F.least(o, F.col("block")).alias("bi"), F.greatest(o, F.col("block")).alias("bj")))
    alone = F.transform(others, lambda o: F.struct(o.alias("bi"), o.alias("bj")))
    placed = placed.select("*", F.inline(F.when(F.col("kind") == 1, alone).otherwise(mine)))
    return placed.groupBy("cell", "bi", "bj").applyInPandas(_query_cell(reach), "kind string, id bigint, other_id bigint")

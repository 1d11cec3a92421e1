"""Points in polygons and boxes, anywhere on the globe, by a plane sweep.

A region is a ring of corners joined by straight lines in latitude and
longitude, the shorter way round. The globe is cut into slabs of longitude at
quantiles of the points; an edge goes to the slabs it spans, a point to one. A
task sweeps its slab from west to east: edges enter and leave as the line
passes their ends, and a point is in a region if an odd number of the region's
edges lie north of it (an even number where the ring runs round the North Pole).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.session import ship

#: Points of a slab aimed at, points of a task, slabs at most, points swept at a time, and pairs of point and edge held at once.
SLAB_ROWS, BLOCK_ROWS, MAX_SLABS, STEP, PAIRS = 20_000, 100_000, 2_048, 1_024, 4_000_000


def box_ring(south: Column, west: Column, north: Column, east: Column) -> Column:
    """The ring of a box; ``east`` below ``west`` passes the 180th meridian, east = west + 360 goes all round."""
    width = F.when(east >= west, east - west).otherwise(east - west + 360)
    corner = lambda lat, k: F.struct(lat.cast("double").alias("lat"), (west + width * k / 4).cast("double").alias("lng"))
    return F.array(*[corner(south, k) for k in range(5)], *[corner(north, k) for k in (4, 3, 2, 1, 0)])


def _edges(regions: DataFrame) -> DataFrame:
    """region, whether the ring holds the North Pole, its range of latitudes, and the ends of each edge from west to east within [-180, 180]."""
    held = regions.select(F.col("id").alias("region"), F.filter("ring", lambda c: c["lat"].isNotNull() & c["lng"].isNotNull() & ~F.isnan(c["lat"]) & ~F.isnan(c["lng"])).alias("r")).where(F.col("region").isNotNull() & (F.size("r") >= 3)).distinct()
    held = held.withColumn("ring_no", F.xxhash64("r"))
    step = lambda a, b: F.pmod(b["lng"] - a["lng"] + 540, F.lit(360.0)) - 180
    after = F.zip_with("r", F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1)), lambda a, b: F.struct(a["lat"].alias("alat"), b["lat"].alias("blat"), F.pmod(a["lng"] + 180, F.lit(360.0)).alias("west"), F.when(step(a, b) == -180, 180.0).otherwise(step(a, b)).alias("turn")))
    held = held.select("region", "ring_no", F.array_min(F.transform("r", lambda c: c["lat"])).alias("south"), F.array_max(F.transform("r", lambda c: c["lat"])).alias("north"), (F.aggregate("r", F.lit(0.0), lambda s, c: s + c["lat"]) >= 0).alias("upper"), after.alias("e"))
    round_ = F.abs(F.aggregate("e", F.lit(0.0), lambda s, x: s + x["turn"])) > 180
    held = held.select("region", "ring_no", "south", "north", round_.alias("round"), (round_ & F.col("upper")).alias("pole"), F.inline("e")).where(F.col("turn") != 0)
    flip = F.col("turn") < 0
    ends = held.select("region", "ring_no", "pole", F.when(F.col("round") & ~F.col("pole"), -91.0).otherwise(F.col("south")).alias("south"), F.when(F.col("pole"), 91.0).otherwise(F.col("north")).alias("north"), F.when(flip, F.col("west") + F.col("turn")).otherwise(F.col("west")).alias("x0"), F.abs("turn").alias("dx"), F.when(flip, F.col("blat")).otherwise(F.col("alat")).alias("y0"), F.when(flip, F.col("alat")).otherwise(F.col("blat")).alias("y1"))
    copies = ends.withColumn("shift", F.explode(F.array(F.lit(-540.0), F.lit(-180.0), F.lit(180.0)))).withColumn("x0", F.col("x0") + F.col("shift")).withColumn("x1", F.col("x0") + F.col("dx"))
    return copies.where((F.col("x1") > -180) & (F.col("x0") < 180)).drop("shift", "dx")


def sweep(lng: np.ndarray, lat: np.ndarray, edges: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (point, ring) with the point in the ring; ``edges`` has ring, x0, x1, y0, y1, south, north and pole of each edge."""
    order, entering = np.argsort(lng, kind="stable"), np.argsort(edges["x0"], kind="stable")
    active, came = np.empty(0, int), 0
    points, rings = [], []
    for first in range(0, len(order), STEP):
        here = order[first : first + STEP]
        west, east = lng[here[0]], lng[here[-1]]
        until = int(np.searchsorted(edges["x0"][entering], east, side="right"))
        active = np.concatenate([active, entering[came:until]])
        came = until
        active = active[edges["x1"][active] > west]
        if not len(active):
            continue
        size = max(1, PAIRS // len(active))
        for k in range(0, len(here), size):
            some = here[k : k + size]
            x, y = lng[some][:, None], lat[some][:, None]
            e = {c: v[active] for c, v in edges.items()}
            p, q = np.nonzero((e["x0"] <= x) & (x < e["x1"]) & (e["south"] <= y) & (y <= e["north"]))
            at = e["y0"][q] + (e["y1"][q] - e["y0"][q]) * ((lng[some][p] - e["x0"][q]) / (e["x1"][q] - e["x0"][q]))
            pair = p * (int(edges["ring"].max()) + 1) + e["ring"][q]
            found, of = np.unique(pair, return_inverse=True)
            above = np.bincount(of, weights=at > lat[some][p], minlength=len(found)).astype(int)
            pole = np.zeros(len(found), bool)
            pole[of] = e["pole"][q]
            inside = (above % 2 == 1) != pole
            points.append(some[found[inside] // (int(edges["ring"].max()) + 1)])
            rings.append(found[inside] % (int(edges["ring"].max()) + 1))
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, int)
    return join(points), join(rings)


def _sweep_task(key: tuple, points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    if points.empty or edges.empty:
        return pd.DataFrame({"id": np.empty(0, "int64"), "region": np.empty(0, "int64")})
    ring, names = pd.factorize(pd.MultiIndex.from_frame(edges[["region", "ring_no"]]))
    held = {c: edges[c].to_numpy() for c in ("x0", "x1", "y0", "y1", "south", "north", "pole")} | {"ring": ring}
    at, of = sweep(points["lng"].to_numpy(), points["lat"].to_numpy(), held)
    region = np.array([n[0] for n in names], "int64")
    return pd.DataFrame({"id": points["id"].to_numpy()[at], "region": region[of]}).drop_duplicates()


def regions_of(points: DataFrame, regions: DataFrame, slab_rows: int = SLAB_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id and region of each point in each region that holds it.

    ``points`` has id BIGINT, lat, lng; ``regions`` id BIGINT and ring
    ARRAY<STRUCT<lat, lng>> (open or closed, of either direction). The south
    and west sides belong to a region, the north and east sides don't. A ring
    that runs once round the globe holds the pole of the half its corners lie in
    on average. Points that are null, not a number or out of range are in no
    region ((0, 0) is a place like any other here); rings of fewer than three
    corners hold nothing; corners that are null or not a number are passed
    over. Repeated rows count once; a point id with several locations is in the
    regions of each. A region id with several rings holds what any of them
    holds. Empty inputs give no rows; other columns are ignored.

    Slabs with many points are worked off in blocks of points, each with the
    slab's edges, so no task sees more than about ``block_rows`` points.
    """
    spark = points.sparkSession
    ship(spark)
    lat, lng = F.col("lat").cast("double"), F.col("lng").cast("double")
    ok = F.col("id").isNotNull() & lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180)
    rows = points.where(ok).select(F.col("id").cast("long").alias("id"), lat.alias("lat"), F.when(lng == 180, -180.0).otherwise(lng).alias("lng")).distinct()
    total = rows.count()
    slabs = min(MAX_SLABS, max(1, total // slab_rows))
    inner = [k / slabs for k in range(1, slabs)]
    bounds = sorted(set(rows.agg(F.percentile_approx("lng", inner, 10_000)).first()[0] or [])) if inner else []
    held = F.array(*[F.lit(b) for b in bounds]).cast("array<double>")
    slab = lambda x: F.size(F.filter(held, lambda b: b <= x))
    placed = rows.withColumn("slab", slab(F.col("lng")))
    full = placed.groupBy("slab").count().where(F.col("count") > block_rows).collect()
    blocks = F.broadcast(spark.createDataFrame([(s, -(-n // block_rows)) for s, n in full] or [(-1, 1)], "slab int, blocks int"))
    placed = placed.join(blocks, "slab", "left").withColumn("block", F.pmod(F.xxhash64("id", "lat", "lng"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    edges = _edges(regions).withColumn("slab", F.explode(F.sequence(slab(F.col("x0")), slab(F.col("x1")))))
    edges = edges.join(blocks, "slab", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)).cast("int") - 1))).drop("blocks")
    found = placed.groupBy("slab", "block").cogroup(edges.groupBy("slab", "block")).applyInPandas(_sweep_task, "id bigint, region bigint")
    return found.distinct()

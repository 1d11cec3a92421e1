"""Buckets of points: a grid, and k-means within crowded cells."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.geo import distance, valid
from quernel.operators.skew import salted_join
from quernel.session import cut, reader_partitions, ship

#: Kilometres of a degree in the grid.
DEGREE_KM = 111.0
#: Coordinates and seeds of a cell that one task clusters; those of fuller cells are taken by rounds of tasks, with the same result.
TASK_SPOTS = 20_000
#: Decimals of a coordinate in sums, which are exact and so the same in whatever order they are merged.
_PLACES = 17
#: Kilometres that rounding may put on a distance.
_SLACK_KM = 0.001
_ROUNDS, _CLOSE = 20, 1e-4


def grid_cells(df: DataFrame, lat: str, lng: str, grid_km: float = 10.0) -> DataFrame:
    """``df`` with the corner of each row's grid cell and its text key (4 decimals); rows without a valid location go."""
    g = grid_km / DEGREE_KM
    rows = df.where(valid(F.col(lat), F.col(lng)))
    rows = rows.withColumn("cell_lat", F.floor(F.col(lat) / g) * g).withColumn("cell_lng", F.floor(F.col(lng) / g) * g)
    return rows.withColumn("cell", F.format_string("%.4f,%.4f", F.col("cell_lat"), F.col("cell_lng")))


def _haversine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared half chords of radians (lat, lng)."""
    return np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each (lat, lng) row the number of its nearest centre by great circle, the lowest of equals.

    The points are halved again and again; a half of radius r about its middle
    only looks at centres at most 2 r farther from the middle than the nearest.
    """
    points, centres = np.radians(points), np.radians(centres)
    label = np.empty(len(points), int)
    todo = [(np.arange(len(points)), np.arange(len(centres)))] if len(points) else []
    while todo:
        rows, near = todo.pop()
        low, high = points[rows].min(0), points[rows].max(0)
        reach, far = (2 * np.arcsin(np.sqrt(np.minimum(1.0, _haversine(x, (low + high) / 2)))) for x in (points[rows], centres[near]))
        near = near[far <= far.min() + 2 * reach.max() + _SLACK_KM / 6371]
        if len(rows) > 64 and len(near) > 64:
            halves = np.argpartition(points[rows, int(np.argmax(high - low))], len(rows) // 2)
            todo += [(rows[halves[: len(rows) // 2]], near), (rows[halves[len(rows) // 2 :]], near)]
            continue
        step = max(1, 2**18 // len(near))
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            label[some] = near[np.argmin(_haversine(points[some, None, :], centres[near][None]), axis=1)]
    return label


def _mean(total: int, n: int) -> float:
    """total / n of sums scaled by 10 ** _PLACES, rounded to as many places half up, as Spark's decimals are."""
    size = (2 * abs(total) + n) // (2 * n)
    return (size if total >= 0 else -size) / 10**_PLACES


def k_means(points: np.ndarray, exact: list[tuple[int, int, int]], centres: np.ndarray) -> np.ndarray:
    """Centre numbers of (lat, lng) rows: nearest by great circle, means of degrees, at most 20 rounds. ``exact``: how many points each row stands for, and its scaled coordinates."""
    for _ in range(_ROUNDS):
        label = nearest(points, centres)
        sums: dict[int, list[int]] = {}
        for c, (w, lat, lng) in zip(label.tolist(), exact):
            total = sums.setdefault(c, [0, 0, 0])
            total[0] += w
            total[1] += w * lat
            total[2] += w * lng
        new = centres.copy()
        for c, (w, lat, lng) in sums.items():
            new[c] = _mean(lat, w), _mean(lng, w)
        moved, centres = np.abs(new - centres).max(), new
        if moved <= _CLOSE:
            return label
    return nearest(points, centres)


_LABELS = "cell string, lat double, lng double, w long, part long"


def _cluster_cell(spots: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    seeds = seeds.sort_values("part")
    exact = [(w, int(a.scaleb(_PLACES)), int(o.scaleb(_PLACES))) for w, a, o in zip(spots["w"].tolist(), spots["xlat"], spots["xlng"])]
    spots["part"] = seeds["part"].to_numpy()[k_means(spots[["lat", "lng"]].to_numpy(float), exact, seeds[["lat", "lng"]].to_numpy(float))]
    return spots[["cell", "lat", "lng", "w", "part"]]


def _label_block(spots: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    centres = centres.sort_values("part")
    spots["part"] = centres["part"].to_numpy()[nearest(spots[["lat", "lng"]].to_numpy(float), centres[["lat", "lng"]].to_numpy(float))]
    return spots[["cell", "lat", "lng", "w", "part"]]


def _ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with the place (from 0) of each row among those of its key; it is sorted in ranges, so no task holds a whole key."""
    rows = df.repartitionByRange(reader_partitions(df.sparkSession), key, *order).sortWithinPartitions(key, *order)
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    begin = rows.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begin = begin.select(key, "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(begin, [key, "_range"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def _rounds(spots: DataFrame, seeds: DataFrame, block: int) -> DataFrame:
    """Labels of the spots as ``k_means`` gives them, by rounds over blocks of spots that lie together and the centres near each block."""
    bits = lambda c: reduce(lambda x, j: x + F.shiftleft(F.shiftright(c, j).bitwiseAND(F.lit(1)), 2 * j), range(16), F.lit(0).cast("long"))
    box = spots.groupBy("cell").agg(*[f(c).alias(f"_{n}{c}") for c in ("lat", "lng") for n, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: F.coalesce(F.floor((F.col(c) - F.col(f"_lo{c}")) / F.nullif(F.col(f"_hi{c}") - F.col(f"_lo{c}"), F.lit(0.0)) * 65535), F.lit(0)).cast("long")
    curve = spots.join(F.broadcast(box), "cell").withColumn("_z", bits(part("lat")) * 2 + bits(part("lng"))).drop(*[c for c in box.columns if c != "cell"])
    spots = cut(_ranked(curve, "cell", ["_z", "lat", "lng"]).withColumn("block", F.floor(F.col("_rank") / block)).drop("_z", "_rank"))
    middle = spots.groupBy("cell", "block").agg(((F.min("lat") + F.max("lat")) / 2).alias("mlat"), ((F.min("lng") + F.max("lng")) / 2).alias("mlng"))
    away = distance(F.col("lat"), F.col("lng"), F.col("mlat"), F.col("mlng"))
    blocks = cut(spots.join(F.broadcast(middle), ["cell", "block"]).groupBy("cell", "block", "mlat", "mlng").agg(F.max(away).alias("_reach")))

    def label(spots: DataFrame, centres: DataFrame) -> DataFrame:
        pairs = centres.join(F.broadcast(blocks), "cell").withColumn("_away", away)
        least = pairs.groupBy("cell", "block").agg(F.min("_away").alias("_least"))
        near = pairs.join(F.broadcast(least), ["cell", "block"]).where(F.col("_away") <= F.col("_least") + 2 * F.col("_reach") + _SLACK_KM).select("cell", "block", "part", "lat", "lng")
        return cut(spots.groupBy("cell", "block").cogroup(near.groupBy("cell", "block")).applyInPandas(_label_block, _LABELS))

    done, centres = [], seeds
    for _ in range(_ROUNDS):
        labels = label(spots, centres)
        w = F.col("w").cast("decimal(12,0)")
        sums = labels.groupBy("cell", "part").agg(F.sum("w").alias("_n"), *[F.sum(F.col(c).cast(f"decimal(20,{_PLACES})") * w).alias(f"_{c}") for c in ("lat", "lng")])
        mean = lambda c: F.coalesce((F.col(f"_{c}") / F.col("_n").cast("decimal(18,0)")).cast("double"), F.col(c))
        new = cut(centres.join(sums, ["cell", "part"], "left").select("cell", "part", mean("lat").alias("lat"), mean("lng").alias("lng"), F.greatest(F.abs(mean("lat") - F.col("lat")), F.abs(mean("lng") - F.col("lng"))).alias("_moved")))
        still = F.broadcast(new.groupBy("cell").agg(F.max("_moved").alias("_moved")).where(F.col("_moved") <= _CLOSE).select("cell"))
        done.append(labels.join(still, "cell", "left_semi"))
        spots, centres = spots.join(still, "cell", "left_anti"), new.drop("_moved").join(still, "cell", "left_anti")
        if centres.isEmpty():
            break
    else:
        done.append(label(spots, centres))
    return reduce(DataFrame.unionByName, done)


def _crowded(rows: DataFrame, target: int, most: int) -> DataFrame:
    """cell, part, member, lat, lng, name of points of crowded cells.

    Equal coordinates are one spot with a weight. Of equal seeds only the first
    _ROUNDS + 1 are kept: while they lie at one place only the first draws
    points, and a round takes at most one of them away.
    """
    placed = _ranked(rows, "cell", ["member", "lat", "lng", "name"])
    if target == 1:
        return placed.withColumn("part", F.col("_rank")).drop("_n", "_rank")
    placed = cut(placed)
    seeds = placed.withColumn("part", F.expr(f"(_rank * ((_n + {target - 1}) div {target}) + _n - 1) div _n")).where(F.expr(f"(part * _n) div ((_n + {target - 1}) div {target}) = _rank"))
    same = Window.partitionBy("cell", "lat", "lng").orderBy("part")
    seeds = cut(seeds.select("cell", "part", "lat", "lng", F.row_number().over(same).alias("_copy")).where(F.col("_copy") <= _ROUNDS + 1).drop("_copy"))
    exact = lambda c: F.col(c).cast(f"decimal(20,{_PLACES})").alias(f"x{c}")
    spots = cut(placed.groupBy("cell", "lat", "lng").agg(F.count(F.lit(1)).alias("w")).select("*", exact("lat"), exact("lng")))
    held = spots.select("cell").unionAll(seeds.select("cell")).groupBy("cell").count()
    full = F.broadcast(cut(held.where(F.col("count") > most).select("cell")))
    small = [x.join(full, "cell", "left_anti").groupBy("cell") for x in (spots, seeds)]
    labels = small[0].cogroup(small[1]).applyInPandas(_cluster_cell, _LABELS)
    large = [x.join(full, "cell", "left_semi") for x in (spots, seeds)]
    if not large[0].isEmpty():
        labels = labels.unionByName(_rounds(*large, most))
    return salted_join(placed.drop("_n", "_rank"), cut(labels), ["cell", "lat", "lng"], "w", "member")


def buckets(df: DataFrame, key: str, lat: str, lng: str, name: str | None = None, target: int = 5, grid_km: float = 10.0, smallest: int = 3, most: int = TASK_SPOTS) -> DataFrame:
    """bucket_id, cell, lat, lng, radius_km (1.1 times the farthest member), n, location_name, box, members.

    Cells with fewer than ``smallest`` points go, as do parts of crowded cells
    that small; cells with more than 3 * ``target`` points are divided by
    k-means into ceil(n / target) parts. Where a cell has more than ``most``
    coordinates and seeds, each round is spread over many tasks; the result is
    the same. The seeds are points spaced evenly in order of the key, so every
    run gives the same.
    """
    ship(df.sparkSession)
    rows = grid_cells(df.where(F.col(key).isNotNull()), lat, lng, grid_km)
    rows = rows.select("cell", F.col(key).cast("string").alias("member"), *[(F.col(c).cast("double") + 0.0).alias(n) for c, n in ((lat, "lat"), (lng, "lng"))], (F.lower(F.col(name)) if name else F.lit(None).cast("string")).alias("name"))
    sizes = cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= smallest).withColumn("_w", F.col("_n")))
    rows = salted_join(rows, sizes, ["cell"], "_w", "member")
    plain = rows.where(F.col("_n") <= 3 * target).select("cell", F.lit(0).cast("long").alias("part"), "member", "lat", "lng", "name")
    parts = cut(plain.unionByName(_crowded(rows.where(F.col("_n") > 3 * target), target, most)))
    group = ["cell", "part"]
    centres = parts.groupBy(*group).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.min("lat").alias("south"), F.min("lng").alias("west"), F.max("lat").alias("north"), F.max("lng").alias("east"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("member")).alias("members"), F.mode("name", True).alias("location_name")).where(F.col("n") >= smallest)
    spots = parts.groupBy(*group, F.col("lat").alias("plat"), F.col("lng").alias("plng")).agg(F.lit(1))
    far = spots.join(centres.select(*group, "lat", "lng"), group).groupBy(*group).agg(F.max(distance(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"))).alias("_far"))
    out = centres.join(far, group).withColumn("radius_km", F.col("_far") * 1.1)
    out = out.withColumn("bucket_id", F.concat_ws("_", F.lit("bucket"), "cell", F.lit("0"), "part"))
    return out.select("bucket_id", "cell", "lat", "lng", "radius_km", "n", "location_name", "south", "west", "north", "east", "members")


def numbered(found: DataFrame) -> DataFrame:
    """Buckets with ``ord``, their place (from 0) in order of their ids; ranges are numbered apart, so no task holds all."""
    return _ranked(found.withColumn("_all", F.lit(0)), "_all", ["bucket_id"]).withColumnRenamed("_rank", "ord").drop("_all")


def bucket_stats(found: DataFrame) -> DataFrame:
    """One row: buckets, mean size to one decimal, smallest, largest, members."""
    return found.agg(F.count(F.lit(1)).alias("buckets"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 1).alias("mean_size"), F.min("n").alias("least"), F.max("n").alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


def bucket_places(found: DataFrame) -> DataFrame:
    """Buckets and members per place name."""
    return found.groupBy("location_name").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("members"))

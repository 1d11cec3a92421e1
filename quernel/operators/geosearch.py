"""Search round a point, a place or a bucket, and text search within it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import geo as G
from quernel.functions import score as S
from quernel.operators.places import first_bucket, normalise

# Hits that make a wider search needless, and the share that hits beyond the first radius keep.
MIN_RESULTS, BEYOND = 5, 0.7
#: Radius of a place without one of its own.
PLACE_KM = 25.0


def geo_index(df: DataFrame, key: str, lat: str, lng: str, buckets: DataFrame | None = None, place: str | None = None, places: DataFrame | None = None) -> DataFrame:
    """Rows with a valid location and key, with the first bucket that holds them and the canonical place name; without ``buckets`` the bucket is the known place's."""
    rows = df.where(F.col(key).isNotNull() & G.valid(F.col(lat), F.col(lng)))
    if buckets is not None:
        rows = first_bucket(rows.drop("bucket_id"), key, lat, lng, buckets)
    if place and places is not None:
        held = rows if buckets is None else rows.withColumnRenamed("bucket_id", "_held")
        rows = normalise(held.drop("bucket_id"), place, places).drop("place_lat", "place_lng", "how")
        rows = rows if buckets is None else rows.drop("bucket_id").withColumnRenamed("_held", "bucket_id")
    return rows


def in_circle(df: DataFrame, lat: str, lng: str, centre: tuple[float, float], radius: float, unit: str = "km", name: str = "distance") -> DataFrame:
    """Rows at most ``radius`` away, with their distance in the unit. A box on plain columns goes to the scan first."""
    lat_, lng_ = F.col(lat).cast("double"), F.col(lng).cast("double")
    rows = df.where(G.box_filter(F.col(lat), F.col(lng), *centre, radius, unit))
    return rows.withColumn(name, G.distance(lat_, lng_, *centre, unit)).where(F.col(name) <= radius)


def by_radius(df: DataFrame, key: str, lat: str, lng: str, centre: tuple[float, float], radius: float, unit: str = "km", limit: int | None = None, max_range: float | None = None, min_results: int = MIN_RESULTS, boosts: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """Rows round a point, nearest first, with distance and relevance.

    With ``max_range`` and fewer than ``min_results`` rows within ``radius`` the
    search widens to it; one plan does both, the count within the radius is a
    scalar subquery. relevance is 1 - distance / range (at least 0), times .7
    beyond the radius, times the largest boost (distance, factor) that covers
    the row and is at least 1. Ties by key.
    """
    wide = max_range if max_range is not None and max_range > radius else None
    rows = in_circle(df, lat, lng, centre, wide or radius, unit)
    if wide:
        near = in_circle(df, lat, lng, centre, radius, unit, "_d").agg(F.count(F.lit(1))).scalar()
        rows = rows.withColumn("_widen", near < min_results).where(F.col("_widen") | (F.col("distance") <= radius))
    else:
        rows = rows.withColumn("_widen", F.lit(False))
    span = F.when(F.col("_widen"), F.lit(float(wide or radius))).otherwise(F.lit(float(radius)))
    base = F.when(span > 0, F.greatest(F.lit(0.0), 1 - F.col("distance") / span)).otherwise(1.0)
    factor = F.greatest(F.lit(1.0), *[F.when(F.col("distance") <= d, float(b)).otherwise(1.0) for d, b in boosts]) if boosts else F.lit(1.0)
    rows = rows.withColumn("relevance", base * F.when(F.col("distance") > radius, BEYOND).otherwise(1.0) * factor).drop("_widen")
    rows = rows.orderBy("distance", key)
    return rows.limit(limit) if limit else rows


def place_centre(places: DataFrame, name: str, default_km: float = PLACE_KM) -> tuple[tuple[float, float], float]:
    """Centre and radius of a place name; ValueError if no coordinates are known."""
    found = normalise(places.sparkSession.createDataFrame([(name,)], "name string"), "name", places).first()
    if found.place_lat is None:
        raise ValueError(f"no coordinates are known for {name}")
    return (found.place_lat, found.place_lng), default_km


def bucket_centre(buckets: DataFrame, bucket_id: str) -> tuple[tuple[float, float], float]:
    """Centre and radius (km) of a bucket; ValueError if it is unknown."""
    found = buckets.where(F.col("bucket_id") == bucket_id).select("lat", "lng", "radius_km").first()
    if found is None:
        raise ValueError(f"no bucket {bucket_id}")
    return (found.lat, found.lng), found.radius_km


def buckets_meeting(buckets: DataFrame, centre: tuple[float, float], radius: float, unit: str = "km") -> DataFrame:
    """Buckets whose centre is in the circle, that hold its centre, or whose box meets its box."""
    d = G.distance(F.col("lat"), F.col("lng"), *centre)
    test = (d <= G.to_km(radius, unit)) | (d <= F.col("radius_km"))
    if "south" in buckets.columns:
        test = test | F.coalesce(G.boxes_meet(G.bounds(*centre, radius, unit), tuple(F.col(c) for c in ("south", "west", "north", "east"))), F.lit(False))
    return buckets.where(test)


def text_and_geo(near: DataFrame, key: str, fields: Sequence[str], query: str, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """The nearest 3 * ``limit`` rows of ``near`` (from ``by_radius``), by .7 text score and .3 relevance, best first."""
    rows = near.orderBy("distance", key).limit(3 * limit)
    rows = rows.withColumn("text_score", S.simple_score([F.col(f) for f in fields], query)).where(F.col("text_score") >= min_score)
    return rows.withColumn("score", F.round(0.7 * F.col("text_score") + 0.3 * F.col("relevance"), 6)).orderBy(F.desc("score"), "distance", key).limit(limit)


def map_listing(df: DataFrame, lat: str, lng: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """Distinct coordinates (4 decimals) in a box with their number of rows."""
    rows = df.where(G.within_bounds(F.col(lat), F.col(lng), south, west, north, east) & G.valid(F.col(lat), F.col(lng)))
    return rows.groupBy(F.round(lat, 4).alias("lat"), F.round(lng, 4).alias("lng")).agg(F.count(F.lit(1)).alias("n"))


def geo_stats(df: DataFrame, bucket: str = "bucket_id") -> DataFrame:
    """Documents per bucket; null is no bucket."""
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("documents"))


def geo_totals(df: DataFrame, bucket: str = "bucket_id") -> DataFrame:
    """One row of a geo index: documents, those in a bucket, buckets that hold any, and the world's bounds."""
    held = F.col(bucket) if bucket in df.columns else F.lit(None).cast("string")
    world = [F.lit(v).alias(n) for n, v in (("south", -90.0), ("west", -180.0), ("north", 90.0), ("east", 180.0))]
    return df.agg(F.count(F.lit(1)).alias("documents"), F.count(held).alias("in_buckets"), F.countDistinct(held).alias("buckets")).select("*", *world)


def search_geo(df: DataFrame, key: str, lat: str, lng: str, geo: Mapping, places: DataFrame | None = None, buckets: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``by_radius`` from an option object: center and radius, locationName, or bucketId."""
    unit = (geo.get("radius") or {}).get("unit", "km")
    if geo.get("locationName"):
        centre, km = place_centre(places, geo["locationName"])
        radius = (geo.get("radius") or {"value": km})["value"]
    elif geo.get("center"):
        centre, radius = (geo["center"]["lat"], geo["center"]["lng"]), geo["radius"]["value"]
    elif geo.get("bucketId"):
        (centre, radius), unit = bucket_centre(buckets, geo["bucketId"]), "km"
    else:
        raise ValueError("geo needs center and radius, locationName or bucketId")
    boosts = [(G.to_km(b["distance"]["value"], b["distance"].get("unit", "km")) / G.IN_KM[unit], b["boost"]) for b in geo.get("distanceBoost", [])]
    wide = geo.get("maxRange")
    wide = G.to_km(wide["value"], wide.get("unit", "km")) / G.IN_KM[unit] if wide else None
    return by_radius(df, key, lat, lng, centre, radius, unit, limit, wide, geo.get("minResults", MIN_RESULTS), boosts)

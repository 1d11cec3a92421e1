"""Place names in one spelling, and the coordinates of known places."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.geo import RADIUS, distance, valid, within_bounds
from quernel.operators.skew import salted_join
from quernel.session import cut, spread

# City buckets as id, name, latitude, longitude, radius in km, aliases.
CITIES = [
    ("nyc", "New York City", 40.7128, -74.006, 50, ["NYC", "New York", "Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"]),
    ("la", "Los Angeles", 34.0522, -118.2437, 50, ["LA", "Los Angeles", "Hollywood", "Santa Monica", "Venice"]),
    ("chicago", "Chicago", 41.8781, -87.6298, 40, ["Chicago", "Chi-Town", "The Windy City"]),
    ("houston", "Houston", 29.7604, -95.3698, 40, ["Houston", "H-Town"]),
    ("phoenix", "Phoenix", 33.4484, -112.074, 40, ["Phoenix", "PHX"]),
    ("sf", "San Francisco", 37.7749, -122.4194, 30, ["SF", "San Francisco", "San Fran", "The City"]),
    ("seattle", "Seattle", 47.6062, -122.3321, 35, ["Seattle", "SEA"]),
    ("miami", "Miami", 25.7617, -80.1918, 35, ["Miami", "MIA", "Miami Beach"]),
    ("boston", "Boston", 42.3601, -71.0589, 30, ["Boston", "BOS"]),
    ("london", "London", 51.5074, -0.1278, 50, ["London", "LDN"]),
    ("paris", "Paris", 48.8566, 2.3522, 40, ["Paris", "PAR"]),
    ("tokyo", "Tokyo", 35.6762, 139.6503, 50, ["Tokyo", "TYO"]),
    ("mumbai", "Mumbai", 19.076, 72.8777, 40, ["Mumbai", "Bombay", "BOM"]),
    ("delhi", "Delhi", 28.6139, 77.209, 40, ["Delhi", "New Delhi", "DEL"]),
    ("bangalore", "Bangalore", 12.9716, 77.5946, 35, ["Bangalore", "Bengaluru", "BLR"]),
]
# Other names as name, canonical name, aliases.
ALIASES = [
    ("The Big Apple", "New York City", ["Big Apple", "NYC"]),
    ("Sin City", "Las Vegas", ["Vegas", "LV", "Las Vegas"]),
    ("Motor City", "Detroit", ["The D", "Detroit", "DTW"]),
    ("Music City", "Nashville", ["Nash", "Nashville", "BNA"]),
    ("The Mile High City", "Denver", ["Denver", "DEN"]),
    ("The Emerald City", "Seattle", ["Seattle", "SEA"]),
    ("The City of Angels", "Los Angeles", ["LA", "Los Angeles", "LAX"]),
    ("The Windy City", "Chicago", ["Chicago", "Chi-Town", "ORD"]),
    ("Philly", "Philadelphia", ["Philadelphia", "PHL"]),
    ("ATX", "Austin", ["Austin", "ATX"]),
    ("The Big Smoke", "London", ["London", "LDN"]),
    ("The City of Light", "Paris", ["Paris", "CDG"]),
    ("The Big Mango", "Bangkok", ["Bangkok", "BKK"]),
    ("The Big Durian", "Jakarta", ["Jakarta", "CGK"]),
]
#: Buckets or known names that a task may hold as an array, and sizes of cells in which more buckets are looked up.
LISTED, LEVELS = 1_000, 20
#: Similarity from which a name counts as a misspelling.
FUZZY = 0.8


def place_key(name: Column) -> Column:
    """Lower case, trimmed, without other than letters, digits, underscores and blanks, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"[^A-Za-z0-9_\s]", ""), r"\s+", " ")


def _letter_pairs(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))


def dice(a: Column, b: Column) -> Column:
    """Twice the pairs of letters of ``a`` found in ``b`` over the pairs of both; 1 if equal, 0 if one is shorter than 2."""
    hits = F.size(F.filter(_letter_pairs(a), lambda g: F.array_contains(_letter_pairs(b), g)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * hits / (F.length(a) + F.length(b) - 2))


def known_places(spark: SparkSession, extra: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """ord, name, canonical, key, alias_keys, bucket_id, lat, lng, radius_km: a row per known name.

    ``extra`` adds (name, canonical, aliases) in front and so overrides. Names
    resolve to their canonical name before coordinates are looked up.
    """
    cities = {c[1]: c for c in CITIES}
    rows, seen = [], set()
    for name, canonical, aliases in [*(extra or []), *[(c[1], c[1], c[5]) for c in CITIES], *ALIASES]:
        key = _plain(name)
        if key not in seen:
            seen.add(key)
            city = cities.get(canonical)
            rows.append((len(rows), name, canonical, key, [_plain(a) for a in aliases if a], city and city[0], city and city[2], city and city[3], city and float(city[4])))
    return spark.createDataFrame(rows, "ord int, name string, canonical string, key string, alias_keys array<string>, bucket_id string, lat double, lng double, radius_km double")


def _plain(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\s]", "", name.lower().strip()))


def normalise(df: DataFrame, column: str, places: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """``df`` with canonical, bucket_id, place_lat, place_lng and how (direct, alias, fuzzy or as_is).

    A name is looked up as a name, as an alias, then as the first known name or
    alias at least ``threshold`` similar; else it stays. Null and empty names
    have null. Each distinct key is resolved once, misspellings by the pairs of
    letters they share; the known places are a short list, broadcast: more than
    ``LISTED`` raise.
    """
    if places.limit(LISTED + 1).count() > LISTED:
        raise ValueError(f"more than {LISTED} known places")
    keys = df.select(place_key(F.col(column)).alias("_key")).where(F.col("_key") != "").distinct()
    entries = places.select("ord", "canonical", F.inline(F.concat(F.array(F.struct(F.lit(0).alias("kind"), "key")), F.transform("alias_keys", lambda a: F.struct(F.lit(1).alias("kind"), a.alias("key"))))))
    equal = keys.join(F.broadcast(entries), F.col("_key") == F.col("key")).select("_key", "kind", "ord", "canonical")
    wide = lambda c: F.length(c) >= 2
    pairs = entries.where(wide("key")).select("ord", "canonical", "key", F.explode(_letter_pairs(F.col("key"))).alias("_pair")).distinct()
    shared = keys.where(wide("_key")).select("_key", F.explode(_letter_pairs(F.col("_key"))).alias("_pair")).join(F.broadcast(pairs), "_pair").groupBy("_key", "ord", "canonical", "key").agg(F.count(F.lit(1)).alias("_n"))
    close = shared.where(2.0 * F.col("_n") / (F.length("_key") + F.length("key") - 2) >= threshold).select("_key", F.lit(2).alias("kind"), "ord", "canonical")
    best = equal.unionByName(close).groupBy("_key").agg(F.min(F.struct("kind", "ord", "canonical")).alias("_b"))
    hits = best.select("_key", F.col("_b.canonical").alias("_canonical"), F.element_at(F.array(F.lit("direct"), F.lit("alias"), F.lit("fuzzy")), F.col("_b.kind") + 1).alias("_how"))
    where = places.where(F.col("lat").isNotNull()).groupBy(F.col("canonical").alias("_canonical")).agg(F.first("bucket_id").alias("bucket_id"), F.first("lat").alias("place_lat"), F.first("lng").alias("place_lng"))
    hits = hits.join(F.broadcast(where), "_canonical", "left")
    out = df.withColumn("_key", place_key(F.col(column))).join(hits, "_key", "left").drop("_key")
    usable = F.coalesce(F.col(column), F.lit("")) != ""
    return out.withColumn("canonical", F.when(usable, F.coalesce("_canonical", column))).withColumn("how", F.when(usable, F.coalesce("_how", F.lit("as_is")))).drop("_canonical", "_how")


def variations(places: DataFrame, canonical: str) -> DataFrame:
    """All keys under which a canonical name is known."""
    return places.where(F.col("canonical") == canonical).select(F.explode(F.array_union(F.array("key"), "alias_keys")).alias("variation")).distinct()


def place_stats(places: DataFrame) -> DataFrame:
    return places.agg(F.count(F.lit(1)).alias("names"), F.sum(F.size("alias_keys")).alias("aliases"), F.countDistinct("canonical").alias("canonical_names"))


def first_bucket(df: DataFrame, key: str, lat: str, lng: str, buckets: DataFrame, most: int = LISTED) -> DataFrame:
    """``df`` with ``bucket_id``: the first bucket in list order whose circle or box holds the point; null for none.

    ``buckets`` has ord, bucket_id, lat, lng, radius_km, and optionally south,
    west, north, east. Up to ``most`` of them are held as an array in each
    task; more are found by a join on cells of space, with the same result.
    """
    boxed = "south" in buckets.columns
    columns = ["ord", "bucket_id", F.col("lat").alias("blat"), F.col("lng").alias("blng"), "radius_km", (F.degrees(F.col("radius_km") / RADIUS["km"]) * 1.0001 + 1e-9).alias("reach"), *(["south", "west", "north", "east"] if boxed else [])]
    near = lambda b: F.when(F.abs(F.col(lat) - b["blat"]) <= b["reach"], distance(F.col(lat), F.col(lng), b["blat"], b["blng"]) <= b["radius_km"]).otherwise(False)
    inside = lambda b: near(b) | (F.coalesce(within_bounds(F.col(lat), F.col(lng), b["south"], b["west"], b["north"], b["east"]), F.lit(False)) if boxed else F.lit(False))
    if buckets.limit(most + 1).count() > most:
        return _first_of_many(df, key, lat, lng, buckets.select(F.struct(*columns).alias("b")), inside, boxed)
    listed = buckets.agg(F.sort_array(F.collect_list(F.struct(*columns))))
    hit = F.get(F.filter("_all", inside), 0)["bucket_id"]
    return spread(df).withColumn("_all", listed.scalar()).withColumn("bucket_id", F.when(valid(F.col(lat), F.col(lng)), hit)).drop("_all")


def _first_of_many(df: DataFrame, key: str, lat: str, lng: str, listed: DataFrame, inside: Callable[[Column], Column], boxed: bool) -> DataFrame:
    """``first_bucket`` by cells of space of the size of each bucket: a cube grid round the unit sphere, one of ``LEVELS`` sizes a bucket.

    A bucket stands in the at most 27 cells its ball touches, a point in one
    cell of each size that is used; equal coordinates are looked up once.
    """
    axes = lambda a, o: (F.cos(F.radians(a)) * F.cos(F.radians(o)), F.cos(F.radians(a)) * F.sin(F.radians(o)), F.sin(F.radians(a)))
    b = F.col("b")
    ball = 2 * F.sin(F.least(b["radius_km"] / (2 * RADIUS["km"]), F.lit(math.pi / 2))) * 1.0001 + 1e-9
    if boxed:
        # a box lies in the ball round the circle's centre that reaches its farthest side; wide ones are looked up everywhere
        far = F.greatest(*[F.abs(b["blat"] - b[c]) for c in ("south", "north")]) + F.greatest(*[F.abs(b["blng"] - b[c]) for c in ("west", "east")])
        ball = F.greatest(ball, F.when(far.isNull(), 0.0).otherwise(2 * F.sin(F.radians(F.least(far, F.lit(180.0))) / 2) * 1.0001 + 1e-9))
    sized = listed.withColumn("_reach", ball).withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(-F.log2("_reach")).cast("int"))))
    cell = lambda v, level: F.floor((v + 1.0) * F.pow(F.lit(2.0), level)).cast("long")
    for name, v in zip("xyz", axes(b["blat"], b["blng"])):
        sized = sized.withColumn(f"_{name}", F.explode(F.sequence(cell(v - F.col("_reach"), F.col("_level")), cell(v + F.col("_reach"), F.col("_level")))))
    sized = sized.drop("_reach")
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())
    spots = df.where(valid(F.col(lat), F.col(lng))).groupBy(F.col(lat).alias("_lat"), F.col(lng).alias("_lng")).agg(F.count(F.lit(1)).alias("_rows"))
    spots = cut(spots.withColumn(lat, F.col("_lat")).withColumn(lng, F.col("_lng")))
    placed = spots.drop("_rows").withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels])))
    for name, v in zip("xyz", axes(F.col(lat), F.col(lng))):
        placed = placed.withColumn(f"_{name}", cell(v, F.col("_level")))
    hits = placed.join(sized, ["_level", "_x", "_y", "_z"]).where(inside(F.col("b"))).groupBy("_lat", "_lng").agg(F.min(F.struct("b.ord", "b.bucket_id"))["bucket_id"].alias("bucket_id"))
    found = cut(spots.select("_lat", "_lng", "_rows").join(hits, ["_lat", "_lng"], "left"))
    rest = df.drop("bucket_id").withColumn("_lat", F.when(valid(F.col(lat), F.col(lng)), F.col(lat))).withColumn("_lng", F.when(valid(F.col(lat), F.col(lng)), F.col(lng)))
    nowhere = rest.where(F.col("_lat").isNull()).withColumn("bucket_id", F.lit(None).cast("string"))
    return salted_join(rest.where(F.col("_lat").isNotNull()), found, ["_lat", "_lng"], "_rows", key).unionByName(nowhere).drop("_lat", "_lng")

"""Queries of the problems of the core, with SQL for DuckDB where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.regions import box_ring, regions_of
from quernel.operators.selection import exact_quantiles, running_records
from quernel.operators.spatial import near_and_within
from quernel.session import cut, table


def _measured(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "query_log")
    return log.where(F.col("table_name").isNotNull() & (F.col("execution_time_ms") >= 0))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows slower than all earlier ones of their table and UTC day."""
    rows = _measured(spark, d).select("table_name", "id", "logged_ms", "execution_time_ms")
    rows = rows.withColumn("day", F.floor(F.col("logged_ms") / 86_400_000))
    return running_records(rows, ["table_name", "day"], ["logged_ms", "id"], "execution_time_ms").select("table_name", "id")


def p3_cut(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p3_found with keys cut into leaves of 64 rows, so that cutting is at work at every scale."""
    rows = _measured(spark, d).select("table_name", "id", "logged_ms", "execution_time_ms")
    rows = rows.withColumn("day", F.floor(F.col("logged_ms") / 86_400_000))
    return running_records(rows, ["table_name", "day"], ["logged_ms", "id"], "execution_time_ms", block_rows=64).select("table_name", "id")


def p3_quantiles(spark: SparkSession, d: str, small: int = 20_000) -> DataFrame:
    """Exact median and 90th percentile of the time per table."""
    rows = cut(_measured(spark, d).select("id", "table_name", "execution_time_ms").distinct().drop("id"))
    found = exact_quantiles(rows, ["table_name"], "execution_time_ms", [0.5, 0.9], small=small)
    return found.select("table_name", F.col("prob").alias("prob"), F.col("value").cast("double").alias("value"), F.col("n").alias("n"))


def p3_quantiles_refined(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p3_quantiles with tables of over 100 rows refined, so that refinement is at work at every scale."""
    return p3_quantiles(spark, d, 100)


def p6_found(spark: SparkSession, d: str, cell_rows: int = 20_000) -> DataFrame:
    """Documents at most 0.2 km apart, and the buckets that hold each document."""
    points = table(spark, d, "geo_documents").select(F.col("geo_id").alias("id"), "location.lat", "location.lng")
    unit = F.col("radius.unit")
    km = F.when(unit == "km", 1.0).when(unit == "mi", 1.609344).when(unit == "m", 0.001) * F.col("radius.value")
    regions = table(spark, d, "geo_buckets").select(F.col("bucket_no").alias("id"), "center.lat", "center.lng", km.alias("radius_km"))
    return near_and_within(points, regions, 0.2, cell_rows).select("kind", F.col("id").alias("geo_id"), "other_id")


def p6_split(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p6_found with cells of about 200 points, so that splits and halos are at work at every scale."""
    return p6_found(spark, d, 200)


def p6_regions(spark: SparkSession, d: str) -> DataFrame:
    """The documents in the box round each bucket's circle, by plane sweep; boxes may pass the 180th meridian or reach a pole."""
    points = table(spark, d, "geo_documents").select(F.col("geo_id").alias("id"), "location.lat", "location.lng")
    unit, lat, lng = F.col("radius.unit"), F.col("center.lat"), F.col("center.lng")
    km = F.when(unit == "km", 1.0).when(unit == "mi", 1.609344).when(unit == "m", 0.001) * F.col("radius.value")
    reach = F.degrees(km / 6371)
    across = F.least(F.lit(180.0), reach / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    boxes = table(spark, d, "geo_buckets").where(lat.isNotNull() & lng.isNotNull() & (reach > 0)).select(F.col("bucket_no").alias("id"), box_ring(F.greatest(lat - reach, F.lit(-90.0)), lng - across, F.least(lat + reach, F.lit(90.0)), lng + across).alias("ring"))
    return regions_of(points, boxes).select(F.col("id").alias("geo_id"), F.col("region").alias("bucket_no"))


QUERIES = {f.__name__: f for f in (p3_found, p3_cut, p3_quantiles, p3_quantiles_refined, p6_found, p6_split, p6_regions)}

_MEASURED = "SELECT DISTINCT id, table_name, logged_ms, execution_time_ms AS ms FROM query_log WHERE table_name IS NOT NULL AND execution_time_ms >= 0"
SQL = {
    "p3_found": f"""
        WITH m AS ({_MEASURED}), w AS (
            SELECT table_name, id, ms, max(ms) OVER (PARTITION BY table_name, logged_ms // 86400000 ORDER BY logged_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM m)
        SELECT table_name, id FROM w WHERE ms > most""",
    "p3_quantiles": f"""
        WITH m AS ({_MEASURED}), r AS (
            SELECT table_name, CAST(ms AS DOUBLE) AS value, row_number() OVER (PARTITION BY table_name ORDER BY ms) AS k, count(*) OVER (PARTITION BY table_name) AS n FROM m)
        SELECT table_name, p.prob AS prob, value, n FROM r JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) p(prob) ON k = greatest(1, ceil(p.prob * n))""",
    "p6_found": """
        WITH g AS (SELECT DISTINCT geo_id, location.lat AS lat, location.lng AS lng FROM geo_documents
                   WHERE location.lat BETWEEN -90 AND 90 AND location.lng BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lng = 0)),
        v AS (SELECT geo_id, cos(radians(lat)) * cos(radians(lng)) AS x, cos(radians(lat)) * sin(radians(lng)) AS y, sin(radians(lat)) AS z FROM g),
        c AS (SELECT *, CAST(floor(x * 20000) AS INT) AS cx, CAST(floor(y * 20000) AS INT) AS cy, CAST(floor(z * 20000) AS INT) AS cz FROM v),
        s AS (SELECT unnest([-1, 0, 1]) AS s),
        h AS (SELECT c.geo_id, c.x, c.y, c.z, c.cx + a.s AS cx, c.cy + b.s AS cy, c.cz + e.s AS cz FROM c, s a, s b, s e),
        n AS (SELECT c.geo_id, h.geo_id AS other_id FROM c JOIN h ON c.cx = h.cx AND c.cy = h.cy AND c.cz = h.cz AND c.geo_id < h.geo_id
              WHERE (c.x - h.x) ** 2 + (c.y - h.y) ** 2 + (c.z - h.z) ** 2 <= (2 * sin(0.2 / 12742.0)) ** 2),
        b AS (SELECT bucket_no, center.lat AS lat, center.lng AS lng, radius.value * CASE radius.unit WHEN 'km' THEN 1.0 WHEN 'mi' THEN 1.609344 ELSE 0.001 END AS km FROM geo_buckets)
        SELECT 'near' AS kind, geo_id, other_id FROM n
        UNION ALL
        SELECT 'bucket', geo_id, bucket_no FROM g JOIN b
          ON 12742.0 * asin(least(1.0, sqrt(sin(radians(g.lat - b.lat) / 2) ** 2 + cos(radians(g.lat)) * cos(radians(b.lat)) * sin(radians(g.lng - b.lng) / 2) ** 2))) <= km""",
}
SQL |= {"p3_cut": SQL["p3_found"], "p3_quantiles_refined": SQL["p3_quantiles"], "p6_split": SQL["p6_found"]}
SQL["p6_regions"] = """
        WITH g AS (SELECT DISTINCT geo_id, location.lat AS lat, location.lng AS lng FROM geo_documents WHERE location.lat BETWEEN -90 AND 90 AND location.lng BETWEEN -180 AND 180),
        b AS (SELECT bucket_no, center.lat AS blat, center.lng AS blng, degrees(radius.value * CASE radius.unit WHEN 'km' THEN 1.0 WHEN 'mi' THEN 1.609344 ELSE 0.001 END / 6371) AS reach FROM geo_buckets),
        x AS (SELECT *, least(180.0, reach / greatest(cos(radians(blat)), 1e-6)) AS across FROM b)
        SELECT DISTINCT geo_id, bucket_no FROM g JOIN x ON lat >= greatest(blat - reach, -90) AND lat < least(blat + reach, 90) AND abs(((lng - blng + 540.0) % 360.0) - 180.0) < across"""

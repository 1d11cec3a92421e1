"""Figures of a query log: table_name, query_type, execution_time_ms, cache_hit, an epoch instant in ms, and more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of statements, and upper bounds of the speed bands in ms.
KINDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")
BANDS = {"very fast": 10, "fast": 50, "good": 200, "slow": 500}


def statement_kind(sql: Column) -> Column:
    """The statement's first word if it is a known kind, else OTHER."""
    text = F.upper(F.trim(sql))
    out = F.lit("OTHER")
    for kind in reversed(KINDS):
        out = F.when(text.startswith(kind), kind).otherwise(out)
    return out


def statement_table(sql: Column) -> Column:
    """The table a statement reads or writes; null if none is found."""
    kind = statement_kind(sql)
    take = lambda before: F.nullif(F.regexp_extract(F.trim(sql), rf"(?i){before}\s+`?(\w+)`?", 1), F.lit(""))
    ddl = take(r"TABLE(?:\s+IF\s+(?:NOT\s+)?EXISTS)?")
    return F.when(kind == "SELECT", take("FROM")).when(kind == "INSERT", take(r"INSERT\s+INTO")).when(kind == "UPDATE", take("UPDATE")).when(kind == "DELETE", take(r"DELETE\s+FROM")).when(kind.isin("CREATE", "ALTER", "DROP"), ddl)


def speed_band(ms: Column) -> Column:
    out = F.lit("very slow")
    for name, below in reversed(BANDS.items()):
        out = F.when(ms < below, name).otherwise(out)
    return F.when(ms.isNotNull(), out)


def _since(log: DataFrame, now_ms: int | None, hours: float | None) -> DataFrame:
    return log if now_ms is None or hours is None else log.where(F.col("logged_ms") >= int(now_ms - hours * 3_600_000))


def summary(log: DataFrame, now_ms: int | None = None, hours: float | None = None) -> DataFrame:
    """One row over the last hours: total, mean, min and max ms, hits, misses, share of hits in per cent (null hits count as neither)."""
    rows = _since(log, now_ms, hours)
    hits, misses = F.count_if(F.col("cache_hit")), F.count_if(~F.col("cache_hit"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.avg(F.col("execution_time_ms").cast("double")).alias("mean_ms"), F.min("execution_time_ms").cast("double").alias("min_ms"), F.max("execution_time_ms").cast("double").alias("max_ms"), hits.alias("hits"), misses.alias("misses"), F.round(100 * hits / F.nullif(hits + misses, F.lit(0)), 2).alias("hit_percent"))


def by_column(log: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Count and mean ms per value, most first, ties by value."""
    rows = log.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("execution_time_ms").cast("double")).alias("mean_ms")).orderBy(F.desc("n"), F.col(column).asc_nulls_first())
    return rows.limit(limit) if limit else rows


def hourly(log: DataFrame) -> DataFrame:
    """Count, mean ms and hits per UTC hour, in order."""
    hour = F.date_trunc("hour", F.timestamp_millis("logged_ms")).cast("timestamp_ntz")
    return log.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("execution_time_ms").cast("double")).alias("mean_ms"), F.count_if("cache_hit").alias("hits")).orderBy("hour")


def slow(log: DataFrame, k: int = 10, table: str | None = None, at_least: float | None = None) -> DataFrame:
    """The k slowest queries, ties by id."""
    rows = log if table is None else log.where(F.col("table_name") == table)
    rows = rows if at_least is None else rows.where(F.col("execution_time_ms") >= at_least)
    return rows.orderBy(F.desc_nulls_last("execution_time_ms"), "id").limit(k)


def metrics(log: DataFrame, failed: Column) -> DataFrame:
    """One row: total, mean, min, max ms and the share of failures in per cent."""
    return log.agg(F.count(F.lit(1)).alias("total"), F.avg(F.col("execution_time_ms").cast("double")).alias("mean_ms"), F.min("execution_time_ms").cast("double").alias("min_ms"), F.max("execution_time_ms").cast("double").alias("max_ms"), F.round(100 * F.count_if(failed) / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("failed_percent"))


def access_stats(log: DataFrame, canonical: Column) -> DataFrame:
    """Accesses, mean ms and last access per (table_name, query_type, canonical filters)."""
    return log.groupBy("table_name", "query_type", canonical.alias("filters")).agg(F.count(F.lit(1)).alias("access_count"), F.avg(F.col("execution_time_ms").cast("double")).alias("avg_execution_time"), F.max("logged_ms").alias("last_accessed_ms"))


def top_queries(stats: DataFrame, now: Column, limit: int = 10, at_least: int = 5, within_s: float = 3600) -> DataFrame:
    """Per table the most accessed recent queries: count falling, mean time rising, id."""
    recent = stats.where((F.col("access_count") >= at_least) & (F.unix_micros(F.col("last_accessed_at").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - int(within_s * 1e6)))
    order = Window.partitionBy("table_name").orderBy(F.desc("access_count"), F.asc_nulls_last("avg_execution_time"), "query_id")
    return recent.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def tracked_tables(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("table_name").isNotNull()).select("table_name").distinct().orderBy("table_name")


def without_old(stats: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    return stats.where(F.unix_micros(F.col("last_accessed_at").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - int(hours * 3.6e9))


def stats_summary(stats: DataFrame) -> DataFrame:
    """One row: queries, accesses, tables, mean of the mean times."""
    return stats.agg(F.count(F.lit(1)).alias("queries"), F.sum("access_count").alias("accesses"), F.countDistinct("table_name").alias("tables"), F.avg(F.col("avg_execution_time").cast("double")).alias("mean_ms"))

"""Percentiles per group with bounded error from mergeable compactor hierarchies.

A sketch is a hierarchy of compactors: a full one is sorted, a random half of
its values (every other one) moves up with double weight, and two sketches
merge level by level. Spark's KLL aggregates are such hierarchies inside the
JVM; here they are built per group and part (a day, a file), kept as rows, and
merged later. The rank error of a percentile is about 2.3 / k ** 0.9 (with 99 %
probability); up to k values a sketch is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the compactors; about 0.45 % of the rank.
K = 1024


def rank_error(k: int = K) -> float:
    """The rank error that a percentile stays within, with 99 % probability."""
    return 2.296 / k**0.9021


def sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """Keys, ``sketch`` and ``n`` (values held) per group; rows that can be stored and merged with others.

    Null and NaN values are no measurements; a group without others has no row.
    A null key is a key. Partial sketches are made before the shuffle.
    """
    rows = df.select(*[F.col(c) for c in keys], F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", k).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merge(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches of separate days, files or runs joined per group."""
    return parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def percentiles(merged: DataFrame, keys: list[str], probs: list[float], k: int = K) -> DataFrame:
    """Keys, n, and a row per prob with the estimate and the values at the ends of the rank error."""
    error = rank_error(k)
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, p))))
    rows = [F.struct(F.lit(float(p)).alias("prob"), at(p).alias("value"), at(p - error).alias("low"), at(p + error).alias("high")) for p in probs]
    return merged.select(*keys, "n", F.inline(F.array(*rows)))

"""A join that spreads hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys at most; their hashes are all that is broadcast (16 bytes each).
MAX_HOT = 10_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: str, limit: int = 100_000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which holds each key once and in ``weight`` its rows in ``left``.

    Keys with more than ``limit`` rows (more where there are very many rows, so
    that at most ``MAX_HOT`` keys are hot) are split by a hash of ``spread``
    into shares of at most about that size, and their row of ``right`` is
    repeated for each share. Null keys join null keys. ``right`` is used more
    than once and should be written. The result has the keys, the other columns
    of ``left`` and of ``right`` without ``weight``.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = max(limit, total // MAX_HOT)
    h = F.xxhash64(*[F.col(k) for k in keys])
    hot = right.where(F.col(weight) > limit).groupBy(h.alias("_h")).agg(F.max(F.ceil(F.col(weight) / limit)).cast("int").alias("_s"))
    spread_left = left.withColumn("_h", h).join(F.broadcast(hot), "_h", "left").withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.coalesce("_s", F.lit(1)))).drop("_h", "_s")
    spread_right = right.withColumn("_h", h).join(F.broadcast(hot), "_h", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_s", F.lit(1)).cast("long") - 1))).drop("_h", "_s", weight)
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l._salt") == F.col("r._salt")]
    kept = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns if c not in (*keys, weight)]
    return spread_left.alias("l").join(spread_right.alias("r"), reduce(lambda a, b: a & b, on)).select(*kept)

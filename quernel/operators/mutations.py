"""Writes as new versions of a table.

A table is a plan; a write makes the next plan. ``VersionedTable`` keeps the
current one and writes a snapshot to the shared folder every few writes, so
that plans stay short and survive the loss of executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernel.plans.predicates import checked
from quernel.session import forget_at_end, new_path


def rows_frame(like: DataFrame, rows: Sequence[Mapping]) -> DataFrame:
    """Rows as a frame with the columns of the first, in the table's types."""
    names = list(rows[0])
    if unknown := [n for n in names if n not in like.columns]:
        raise ValueError(f"no column {', '.join(unknown)}")
    schema = StructType([f for f in like.schema.fields if f.name in names])
    for field in schema.fields:
        field.nullable = True
    values = [tuple(None if r.get(f.name) is None else checked(r[f.name], f.dataType) for f in schema.fields) for r in rows]
    return like.sparkSession.createDataFrame(values, schema)


def insert(df: DataFrame, new: DataFrame, key: str | None) -> tuple[DataFrame, DataFrame]:
    """``df`` with the rows of ``new``, and those rows with keys: null or missing ones continue after the highest. Without ``key`` none are made.

    The window numbers the rows of one insert call (given by the caller), never the table.
    """
    if key is None:
        return df.unionByName(new, allowMissingColumns=True), new
    kind = df.schema[key].dataType
    if key not in new.columns:
        new = new.withColumn(key, F.lit(None).cast(kind))
    top = df.agg(F.max(key)).first()[0] or 0
    numbered = new.withColumn("_n", F.monotonically_increasing_id()).withColumn("_m", F.when(F.col(key).isNull(), F.row_number().over(Window.partitionBy(F.col(key).isNull()).orderBy("_n"))))
    filled = numbered.withColumn(key, F.coalesce(F.col(key), (F.lit(top) + F.col("_m")).cast(kind))).drop("_n", "_m")
    return df.unionByName(filled, allowMissingColumns=True), filled


def update(df: DataFrame, test: Column, patch: Mapping[str, object]) -> DataFrame:
    """Rows that meet the test get the patch; a null test keeps a row as it is."""
    if unknown := [n for n in patch if n not in df.columns]:
        raise ValueError(f"no column {', '.join(unknown)}")
    hit = F.coalesce(test, F.lit(False))
    value = lambda f: patch[f.name] if isinstance(patch[f.name], Column) else F.lit(None if patch[f.name] is None else checked(patch[f.name], f.dataType))
    return df.select(*[F.when(hit, value(f).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in patch else F.col(f"`{f.name}`") for f in df.schema.fields])


def delete(df: DataFrame, test: Column) -> DataFrame:
    """Without the rows that meet the test; a null test keeps a row."""
    return df.where(~F.coalesce(test, F.lit(False)))


def upsert_stats(stats: DataFrame, log: DataFrame) -> DataFrame:
    """Running figures per query_id joined with a batch of accesses.

    ``stats`` and ``log`` group by query_id; counts add up, averages are
    weighted by counts, the last access is the later one. Null times count as
    accesses but not in the average.
    """
    batch = log.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("execution_time_ms").cast("double")).alias("_avg"), F.max("accessed_at").alias("_last"))
    both = stats.join(batch, "query_id", "full_outer")
    n, m = F.coalesce("access_count", F.lit(0)), F.coalesce("_n", F.lit(0))
    old, new = F.col("avg_execution_time").cast("double"), F.col("_avg").cast("double")
    mean = F.when(old.isNull(), new).when(new.isNull(), old).otherwise((old * n + new * m) / (n + m))
    return both.select("query_id", (n + m).alias("access_count"), mean.alias("avg_execution_time"), F.greatest("last_accessed_at", "_last").alias("last_accessed_at"))


class VersionedTable:
    """The current plan of a table and its version; every write adds one."""

    def __init__(self, name: str, df: DataFrame, snapshot_every: int = 5) -> None:
        self.name, self.df, self.version, self.snapshot_every = name, df, 0, snapshot_every

    def become(self, df: DataFrame) -> None:
        self.version += 1
        if self.version % self.snapshot_every == 0:
            path = new_path(df.sparkSession, f"{self.name}-v{self.version}")
            df.write.parquet(path)
            forget_at_end(df.sparkSession, path)
            df = df.sparkSession.read.schema(df.schema).parquet(path)
        self.df = df

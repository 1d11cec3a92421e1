"""Reading and writing tables, and the casts that rows get when read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "jdbc")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table of a known format. JSON and CSV want a schema (else they are read twice); jdbc takes url and dbtable as options."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind == "jdbc":
        return reader.option("dbtable", path).load() if "dbtable" not in options else reader.load()
    if kind == "csv" and "header" not in options:
        reader = reader.option("header", "true")
    return reader.load(path)


def read_database(spark: SparkSession, url: str, name: str, key: str, partitions: int | None = None, **options: str) -> DataFrame:
    """A table of a database, read by many tasks at once.

    The range of the whole-number column ``key`` is asked first and cut into
    ``partitions`` (default: the session's cores) strides, one query each; rows
    with a null key are in the first. An empty table is read by one task.
    """
    ask = spark.read.format("jdbc").options(url=url, **options)
    low, high = ask.option("query", f"SELECT MIN({key}) AS a, MAX({key}) AS b FROM {name}").load().first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if low is not None and high > low:
        parts = partitions or spark.sparkContext.defaultParallelism
        reader = reader.options(partitionColumn=key, lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(parts))
    return reader.load()


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: Iterable[str] = ()) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    writer = df.write.format(kind).mode(mode).partitionBy(*partition_by)
    (writer.option("header", "true") if kind == "csv" else writer).save(path)


def cast_read(df: DataFrame, flags: Iterable[str] = (), json: Iterable[str] = ()) -> DataFrame:
    """Number flags become truth values (1 is true, others false, null null); text that looks like a JSON object or list becomes a VARIANT, null if it doesn't parse.

    The text itself stays under its name; the parsed value is ``<name>_json``.
    """
    for name in flags:
        df = df.withColumn(name, F.col(name) == 1)
    for name in json:
        text = F.trim(F.col(name))
        df = df.withColumn(f"{name}_json", F.when(text.rlike(r"(?s)^(\{.*\}|\[.*\])$"), F.try_parse_json(text)))
    return df


def healthy(spark: SparkSession) -> bool:
    """Whether the session answers."""
    return spark.sql("SELECT 1 AS one").first().one == 1

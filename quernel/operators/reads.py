"""Projection, order, paging and counting of a filtered table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_columns(df: DataFrame, order_by: str | Mapping | Iterable | None, key: Iterable[str] = ()) -> list[Column]:
    """Sort columns: 'name DESC, other', {column, direction} or a list of these.

    Nulls come first ascending and last descending. The key is appended so that
    a limit is the same on every run. Unknown names raise ValueError.
    """
    if not order_by:
        specs = []
    elif isinstance(order_by, str):
        specs = [(part.split()[0], part.split()[1] if len(part.split()) > 1 else "ASC") for part in order_by.split(",") if part.strip()]
    else:
        items = [order_by] if isinstance(order_by, Mapping) else order_by
        specs = [(i, "ASC") if isinstance(i, str) else (i["column"], i.get("direction", "ASC")) for i in items]
    out, seen = [], set()
    for name, direction in [*specs, *[(k, "ASC") for k in key]]:
        if name not in df.columns or direction.upper() not in ("ASC", "DESC"):
            raise ValueError(f"can't order by {name} {direction}")
        if name not in seen:
            seen.add(name)
            out.append(F.col(f"`{name}`").desc_nulls_last() if direction.upper() == "DESC" else F.col(f"`{name}`").asc_nulls_first())
    return out


def project(df: DataFrame, select: Iterable[str] | None) -> DataFrame:
    """The named columns, checked against the schema; all for none or '*'."""
    names = list(select or ["*"])
    if "*" in names:
        return df
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    return df.select(*[f"`{n}`" for n in names])


def paged(df: DataFrame, order: list[Column], limit: int | None, offset: int | None) -> DataFrame:
    """Sorted and cut; a limit of 0, None or less and an offset of 0 or None don't cut."""
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(int(offset))
    return df.limit(int(limit)) if limit and int(limit) > 0 else df


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with ``total`` rows of all pages and whether there are more.

    The total is a scalar subquery (map-side counts), not a window over the
    whole table in one task.
    """
    page = paged(df, order, limit, offset)
    return page.withColumn("total", counted(df).scalar()).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def top_by(df: DataFrame, metric: str, k: int, key: Iterable[str]) -> DataFrame:
    """The k rows of highest metric."""
    return df.orderBy(F.col(metric).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in key]).limit(k)


def top_per(df: DataFrame, group: str, metric: str, k: int, key: Iterable[str]) -> DataFrame:
    """The k rows of highest metric of each group; the window is limited before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(metric).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in key]))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def grouped(df: DataFrame, column: str) -> DataFrame:
    """How many rows each value has, most first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_first())

"""Column names between snake_case and camelCase."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def to_camel(name: str) -> str:
    """Each underscore with a small letter after it becomes the capital."""
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), name)


def to_snake(name: str) -> str:
    """Each capital becomes an underscore and the small letter."""
    return re.sub(r"[A-Z]", lambda m: "_" + m.group().lower(), name)


def camel_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[to_camel(c) for c in df.columns])


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[to_snake(c) for c in df.columns])

"""Declared keys and foreign keys of tables, and the graph they form.

Parquet has no keys, so a catalog declares them. The graph is tiny and lives
on the driver.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Edge:
    """``table.column`` refers to ``parent.parent_column``."""

    table: str
    column: str
    parent: str
    parent_column: str
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass(frozen=True)
class TableInfo:
    """What a table declares: key columns, text fields with boosts, tokenizer, coordinate columns, JSON and flag columns."""

    name: str
    key: tuple[str, ...] = ("id",)
    search_fields: tuple[tuple[str, float], ...] = ()
    tokenizer: str = "simple"
    lat: str | None = None
    lng: str | None = None
    place: str | None = None
    json_columns: tuple[str, ...] = ()
    flag_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    """Limits and switches; ``load`` reads them from JSON with environment overrides."""

    default_ttl: float = 60.0
    count_ttl: float = 30.0
    raw_ttl: float = 60.0
    warm_ttl: float = 300.0
    max_keys: int = 10_000
    max_depth: int = 3
    strategy: str = "immediate"
    relation_limit: int = 1000
    slow_ms: float = 1000.0
    case_conversion: bool = False
    ignore_case: bool = False
    include_tables: tuple[str, ...] = ()
    exclude_tables: tuple[str, ...] = ()

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, prefix: str = "QUERNEL_") -> Settings:
        """Defaults, then the JSON file (keys in snake or camel case), then PREFIX_NAME variables; unknown keys and wrong values raise."""
        found: dict[str, object] = {}
        if path:
            for key, value in json.loads(Path(path).read_text()).items():
                found[re.sub(r"[A-Z]", lambda m: "_" + m.group().lower(), key)] = value
        for name in cls.__dataclass_fields__:
            if (value := (os.environ if env is None else env).get(prefix + name.upper())) is not None:
                found[name] = value
        if unknown := sorted(set(found) - set(cls.__dataclass_fields__)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        base = cls()
        settings = replace(base, **{k: _as(getattr(base, k), v, k) for k, v in found.items()})
        if settings.strategy not in ("immediate", "lazy", "ttl_only"):
            raise ValueError("strategy must be immediate, lazy or ttl_only")
        if min(settings.default_ttl, settings.count_ttl, settings.max_keys, settings.max_depth) < 0:
            raise ValueError("limits must not be negative")
        return settings


def _as(like: object, value: object, name: str) -> object:
    if isinstance(like, bool):
        if str(value).lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{name} must be true or false")
        return str(value).lower() in ("true", "1")
    if isinstance(like, tuple):
        return tuple(value.split(",") if isinstance(value, str) else value)
    return type(like)(value)


@dataclass
class Catalog:
    """Tables and edges. Tables not declared have the key ``id`` and no edges."""

    tables: dict[str, TableInfo] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)

    def info(self, table: str) -> TableInfo:
        return self.tables.get(table) or TableInfo(table)

    def key(self, table: str, columns: Iterable[str]) -> tuple[str, ...]:
        """The declared key; else ``id``, ``<singular>_id``, ``<table>_id`` or the first ``*_id`` column."""
        columns = list(columns)
        if table in self.tables:
            return self.tables[table].key
        for name in ("id", f"{table.removesuffix('s')}_id", f"{table}_id", *[c for c in columns if c.endswith("_id")]):
            if name in columns:
                return (name,)
        raise ValueError(f"no key is known for {table}")

    def dependents(self, table: str) -> list[str]:
        """Tables that refer to ``table``."""
        return sorted({e.table for e in self.edges if e.parent == table})

    def dependencies(self, table: str) -> list[str]:
        """Tables that ``table`` refers to."""
        return sorted({e.parent for e in self.edges if e.table == table})

    def edges_from(self, table: str) -> list[Edge]:
        return [e for e in self.edges if e.table == table]

    def edges_to(self, table: str) -> list[Edge]:
        return [e for e in self.edges if e.parent == table]

    def cascade(self, table: str, max_depth: int = 3) -> list[str]:
        """Tables reached from ``table`` over edges in both directions within ``max_depth`` steps, without itself."""
        found, near = {table}, [table]
        for _ in range(max_depth):
            near = [t for n in near for t in (*self.dependents(n), *self.dependencies(n)) if t not in found and not found.add(t)]
        return sorted(found - {table})

    def visible(self, names: Iterable[str], settings: Settings) -> list[str]:
        """Table names after the include and exclude lists (exact names)."""
        return [n for n in names if (not settings.include_tables or n in settings.include_tables) and n not in settings.exclude_tables]


def ddl(name: str, schema: StructType, key: Iterable[str] = ()) -> str:
    """A CREATE TABLE text of a schema, for export."""
    rows = [f"  {f.name} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields]
    if key:
        rows.append(f"  PRIMARY KEY ({', '.join(key)})")
    return f"CREATE TABLE {name} (\n" + ",\n".join(rows) + "\n)"


_TYPES = {"boolean": "boolean", "string": "string", "date": "Date", "timestamp": "Date", "timestamp_ntz": "Date", "binary": "string", "variant": "unknown"}


def interface(name: str, schema: StructType) -> str:
    """A TypeScript interface of a schema, for clients."""

    def kind(text: str) -> str:
        if text.startswith("array<"):
            return kind(text[6:-1]) + "[]"
        return _TYPES.get(text, "Record<string, unknown>" if text.startswith(("struct", "map")) else "number")

    title = "".join(part.capitalize() for part in re.split(r"[^A-Za-z0-9]+", name) if part)
    rows = [f"  {f.name}{'?' if f.nullable else ''}: {kind(f.dataType.simpleString())}{' | null' if f.nullable else ''};" for f in schema.fields]
    return f"export interface {title} {{\n" + "\n".join(rows) + "\n}"

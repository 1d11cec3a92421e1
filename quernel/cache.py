"""Results kept by query, dropped by table.

A kept result is a persisted plan. Its key has the table's version, so a write
makes older entries unreadable at once; invalidation also frees them, for the
table and for tables linked to it.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import time
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quernel.catalog import Catalog, Settings


def cache_key(table: str, operation: str, params: object, version: int = 0) -> str:
    """table:operation:version:digest of the parameters, whatever the order of their names."""
    digest = hashlib.sha256(json.dumps(params, sort_keys=True, default=repr).encode()).hexdigest()
    return f"{table}:{operation}:{version}:{digest}"


def parse_key(key: str) -> dict[str, str]:
    table, operation, version, digest = key.split(":")
    return {"table": table, "operation": operation, "version": version, "digest": digest}


@dataclass
class Entry:
    value: object
    until: float
    tables: frozenset[str]


class Cache:
    """At most ``max_keys`` entries, the longest unused goes first."""

    def __init__(self, catalog: Catalog, settings: Settings, clock: Callable[[], float] = time.monotonic) -> None:
        self.catalog, self.settings, self.clock = catalog, settings, clock
        self.entries: OrderedDict[str, Entry] = OrderedDict()
        self.counts: Counter[str] = Counter()

    def get(self, key: str) -> object | None:
        entry = self.entries.get(key)
        if entry is not None and entry.until <= self.clock():
            self.delete(key)
            entry = None
        self.counts["hits" if entry else "misses"] += 1
        if entry:
            self.entries.move_to_end(key)
        return entry.value if entry else None

    def put(self, key: str, value: object, tables: Iterable[str], ttl: float | None = None) -> object:
        """Keep a value; a DataFrame is persisted (memory, then disk)."""
        self.delete(key)
        if isinstance(value, DataFrame):
            value = value.persist()
        self.entries[key] = Entry(value, self.clock() + (self.settings.default_ttl if ttl is None else ttl), frozenset(tables))
        while len(self.entries) > max(1, self.settings.max_keys):
            self.delete(next(iter(self.entries)))
            self.counts["evictions"] += 1
        return value

    def exists(self, key: str) -> bool:
        return key in self.entries and self.entries[key].until > self.clock()

    def ttl(self, key: str) -> float | None:
        return max(0.0, self.entries[key].until - self.clock()) if key in self.entries else None

    def delete(self, key: str) -> bool:
        entry = self.entries.pop(key, None)
        if entry and isinstance(entry.value, DataFrame):
            entry.value.unpersist()
        return entry is not None

    def delete_pattern(self, pattern: str) -> int:
        return sum(self.delete(k) for k in [k for k in self.entries if fnmatch.fnmatchcase(k, pattern)])

    def clear(self) -> int:
        return sum(self.delete(k) for k in list(self.entries))

    def targets(self, table: str) -> list[str]:
        return [table, *self.catalog.cascade(table, self.settings.max_depth)]

    def invalidate(self, table: str, cascade: bool = True) -> int:
        """Drop what was read from the table, and from linked tables; nothing under the ttl_only strategy."""
        if self.settings.strategy == "ttl_only":
            return 0
        gone = set(self.targets(table) if cascade else [table])
        return sum(self.delete(k) for k in [k for k, e in self.entries.items() if e.tables & gone])

    def stats(self) -> dict[str, object]:
        asked = self.counts["hits"] + self.counts["misses"]
        by_table = Counter(parse_key(k)["table"] for k in self.entries)
        return {"hits": self.counts["hits"], "misses": self.counts["misses"], "evictions": self.counts["evictions"], "hit_rate": f"{100 * self.counts['hits'] / asked:.2f}%" if asked else "0.00%", "keys": len(self.entries), "keys_by_table": dict(by_table)}

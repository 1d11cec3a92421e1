"""Functions that run before and after the operations of a table."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable

OPERATIONS = ("findOne", "findMany", "findById", "count", "insertOne", "insertMany", "updateOne", "updateMany", "updateById", "deleteOne", "deleteMany", "deleteById", "raw", "search")
_log = logging.getLogger(__name__)


class Hooks:
    """before hooks take and return the operation's input, and may raise; after hooks see the result, their errors are logged only."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, str, str], list[Callable]] = defaultdict(list)

    def _add(self, side: str, table: str, operation: str, hook: Callable) -> None:
        if operation not in OPERATIONS:
            raise ValueError(f"unknown operation {operation}")
        self._held[side, table, operation].append(hook)

    def before(self, table: str, operation: str, hook: Callable) -> None:
        self._add("before", table, operation, hook)

    def after(self, table: str, operation: str, hook: Callable) -> None:
        self._add("after", table, operation, hook)

    def run_before(self, table: str, operation: str, value: object) -> object:
        """The value after all hooks in order; a hook that returns None leaves it."""
        for hook in self._held.get(("before", table, operation), ()):
            found = hook(value)
            value = value if found is None else found
        return value

    def run_after(self, table: str, operation: str, result: object) -> None:
        for hook in self._held.get(("after", table, operation), ()):
            try:
                hook(result)
            except Exception:
                _log.exception("an after hook of %s %s failed", table, operation)

    def remove(self, table: str, operation: str | None = None) -> None:
        for key in [k for k in self._held if k[1] == table and operation in (None, k[2])]:
            del self._held[key]

    def clear(self) -> None:
        self._held.clear()

    def listed(self) -> list[tuple[str, str, str, int]]:
        return sorted((t, o, s, len(h)) for (s, t, o), h in self._held.items())

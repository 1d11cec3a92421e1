"""Filter objects compiled to one Column, so that Catalyst can push them to the scan.

``where`` maps columns to a value, null, a list or an object of operators;
AND, OR and NOT hold lists of such maps; some, every, none (children) and is,
isNot (parents) are relation filters and are applied by ``relations``.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: A key with this value is skipped, as if it weren't there.
UNSET = object()

LOGICAL = ("AND", "OR", "NOT")
RELATION = ("some", "every", "none", "is", "isNot")


def like_pattern(text: str) -> str:
    """A LIKE pattern that Spark takes: a backslash before an ordinary character goes, one at the end is doubled."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "\\":
            if at + 1 == len(text):
                out.append("\\\\")
            elif text[at + 1] in "%_\\":
                out.append(text[at : at + 2])
                at += 1
        else:
            out.append(text[at])
        at += 1
    return "".join(out)


class Compiler:
    """Compiles filter objects against a schema.

    Names are checked against the schema. Values must convert to the column's
    type, else ValueError: nothing is compared silently with another type.
    """

    def __init__(self, schema: StructType, ignore_case: bool = False, rename: Callable[[str], str] = lambda n: n) -> None:
        self.types = {f.name: f.dataType for f in schema.fields}
        self.ignore_case, self.rename = ignore_case, rename

    def column(self, name: str) -> Column:
        name = self.rename(name)
        if name not in self.types:
            raise ValueError(f"no column {name}")
        found = F.col(f"`{name}`")
        return F.collate(found, "UTF8_LCASE") if self.ignore_case and self.types[name].simpleString() == "string" else found

    def literal(self, name: str, value: object) -> Column:
        kind = self.types[self.rename(name)]
        return F.lit(checked(value, kind)).cast(kind)

    def where(self, where: Mapping | None) -> Column | None:
        """The Column of a filter object; None if it adds no condition."""
        parts = [p for key, value in (where or {}).items() if value is not UNSET and (p := self._entry(key, value)) is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None

    def _entry(self, key: str, value: object) -> Column | None:
        if key in LOGICAL:
            if not isinstance(value, (list, tuple)):
                return None
            parts = [p for w in value if (p := self.where(w)) is not None]
            if not parts:
                return None
            joined = reduce((lambda a, b: a | b) if key == "OR" else (lambda a, b: a & b), parts)
            return ~joined if key == "NOT" else joined
        if isinstance(value, Mapping):
            return self._operators(key, value)
        if isinstance(value, (list, tuple, set, frozenset)):
            return self._in(key, list(value))
        return self._equals(key, value)

    def _operators(self, name: str, spec: Mapping) -> Column | None:
        loose = spec.get("mode") == "insensitive"
        parts = []
        for op, value in spec.items():
            if value is UNSET or op == "mode":
                continue
            if op not in OPERATORS:
                raise ValueError(f"unknown operator {op} on {name}")
            parts.append(OPERATORS[op](self, name, value, loose))
        return reduce(lambda a, b: a & b, parts) if parts else None

    def _equals(self, name: str, value: object) -> Column:
        return self.column(name).isNull() if value is None else self.column(name) == self.literal(name, value)

    def _differs(self, name: str, value: object) -> Column:
        if isinstance(value, Mapping):
            inner = self._operators(name, value)
            return F.lit(True) if inner is None else ~inner
        return self.column(name).isNotNull() if value is None else self.column(name) != self.literal(name, value)

    def _in(self, name: str, values: object) -> Column:
        if not isinstance(values, (list, tuple, set, frozenset)):
            raise ValueError(f"in on {name} takes a list")
        column = self.column(name)
        return column.isin([self.literal(name, v) if v is not None else F.lit(None) for v in values]) if values else F.lit(False)

    def _not_in(self, name: str, values: object) -> Column:
        if not isinstance(values, (list, tuple, set, frozenset)):
            raise ValueError(f"notIn on {name} takes a list")
        return ~self._in(name, values) if values else F.lit(True)

    def _like(self, name: str, pattern: object, loose: bool = False) -> Column:
        if not isinstance(pattern, str):
            raise ValueError(f"a pattern on {name} must be text")
        text, pattern = self.column(name).cast("string"), like_pattern(pattern)
        return F.lower(text).like(pattern.lower()) if loose else text.like(pattern)

    def _null(self, name: str, wanted: bool) -> Column:
        return self.column(name).isNull() if wanted else self.column(name).isNotNull()


def checked(value: object, kind: DataType) -> object:
    """``value`` if it converts to ``kind`` without loss of meaning, else ValueError."""
    name = kind.simpleString()
    try:
        if name in ("tinyint", "smallint", "int", "bigint"):
            if isinstance(value, str):
                return int(value.strip())
            if isinstance(value, float) and value != int(value):
                raise ValueError("not whole")
            return int(value)
        if name in ("float", "double"):
            return float(value)
        if name.startswith("decimal"):
            return decimal.Decimal(str(value))
        if name == "boolean":
            if isinstance(value, bool) or value in (0, 1):
                return bool(value)
            raise ValueError("not a truth value")
        if name in ("date", "timestamp", "timestamp_ntz") and isinstance(value, str):
            found = datetime.datetime.fromisoformat(value.replace("Z", "+00:00"))
            return found.date() if name == "date" else found.replace(tzinfo=None) if name == "timestamp_ntz" else found
        if name == "timestamp_ntz" and isinstance(value, datetime.datetime):
            return value.replace(tzinfo=None)
        if name == "string" and not isinstance(value, str):
            return str(value).lower() if isinstance(value, bool) else str(value)
    except (TypeError, ValueError, decimal.InvalidOperation) as wrong:
        raise ValueError(f"{value!r} is no {name}") from wrong
    return value


def _compare(test: Callable[[Column, Column], Column]) -> Callable:
    return lambda c, name, value, _: test(c.column(name), c.literal(name, value))


_GT, _GTE, _LT, _LTE = (_compare(t) for t in (lambda a, b: a > b, lambda a, b: a >= b, lambda a, b: a < b, lambda a, b: a <= b))

#: Operators by name; those with a dollar sign are the older spelling.
OPERATORS: dict[str, Callable[[Compiler, str, object, bool], Column]] = {
    "equals": lambda c, n, v, _: c._equals(n, v),
    "not": lambda c, n, v, _: c._differs(n, v),
    "gt": _GT,
    "gte": _GTE,
    "lt": _LT,
    "lte": _LTE,
    "in": lambda c, n, v, _: c._in(n, v),
    "notIn": lambda c, n, v, _: c._not_in(n, v),
    "contains": lambda c, n, v, loose: c._like(n, f"%{v}%", loose),
    "startsWith": lambda c, n, v, loose: c._like(n, f"{v}%", loose),
    "endsWith": lambda c, n, v, loose: c._like(n, f"%{v}", loose),
    "isNull": lambda c, n, v, _: c._null(n, bool(v)),
    "isNotNull": lambda c, n, v, _: c._null(n, not v),
    "$gt": _GT,
    "$gte": _GTE,
    "$lt": _LT,
    "$lte": _LTE,
    "$eq": lambda c, n, v, _: c._equals(n, v),
    "$ne": lambda c, n, v, _: c._differs(n, v),
    "$in": lambda c, n, v, _: c._in(n, v),
    "$like": lambda c, n, v, loose: c._like(n, v, loose),
    "$notLike": lambda c, n, v, loose: ~c._like(n, v, loose),
    "$isNull": lambda c, n, v, _: c._null(n, bool(v)),
    "$isNotNull": lambda c, n, v, _: c._null(n, not v),
}

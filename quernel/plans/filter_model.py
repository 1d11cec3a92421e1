"""The flat filter model: andFilter, likeFilter and orFilter with options inside."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column

from quernel.plans.predicates import Compiler

#: Keys of a model or of plain search filters that are no columns.
CONTROL = frozenset("andFilter likeFilter orFilter selectFields orderBy order limit skip page groupByField wildcardQueryString wildCardMatchWithFields".split())
#: Radius of a coordinate pair in andFilter.
PLACE_KM = 25.0


def is_model(where: Mapping | None) -> bool:
    return bool(where) and any(k in where for k in ("andFilter", "likeFilter", "orFilter"))


def compile_model(compiler: Compiler, model: Mapping) -> Column | None:
    """The Column of a filter model; None if it adds no condition.

    andFilter joins equality, find-operator (LIKE), between, minimum/maximum
    and lists (empty: false); nulls are skipped. likeFilter wraps patterns
    without % on both sides. orFilter joins every key of every item by OR.
    wildcardQueryString is looked for in each of wildCardMatchWithFields.
    """
    parts = [p for key, value in (model.get("andFilter") or {}).items() if (p := _one(compiler, key, value)) is not None]
    for key, value in (model.get("likeFilter") or {}).items():
        if value is not None:
            parts.append(compiler._like(key, str(value) if "%" in str(value) else f"%{value}%"))
    either = [p for item in model.get("orFilter") or [] for key, value in item.items() if (p := _one(compiler, key, value)) is not None]
    if either:
        parts.append(reduce(lambda a, b: a | b, either))
    if model.get("wildcardQueryString") and model.get("wildCardMatchWithFields"):
        parts.append(reduce(lambda a, b: a | b, [compiler._like(f, f"%{model['wildcardQueryString']}%", True) for f in model["wildCardMatchWithFields"]]))
    return reduce(lambda a, b: a & b, parts) if parts else None


def _one(compiler: Compiler, name: str, value: object) -> Column | None:
    if value is None:
        return None
    if isinstance(value, (list, tuple)):
        return compiler._in(name, value)
    if isinstance(value, Mapping):
        kind, inner = value.get("_type"), value.get("_value")
        if kind == "find-operator":
            return compiler._like(name, str(inner))
        if kind == "between":
            return compiler.column(name).between(compiler.literal(name, inner[0]), compiler.literal(name, inner[1]))
        low, high = value.get("minimum"), value.get("maximum")
        if low is None and high is None:
            raise ValueError(f"unknown filter on {name}")
        column = compiler.column(name)
        parts = ([column >= compiler.literal(name, low)] if low is not None else []) + ([column <= compiler.literal(name, high)] if high is not None else [])
        return reduce(lambda a, b: a & b, parts)
    return compiler._equals(name, value)


def plain_filters(compiler: Compiler, filters: Mapping | None) -> Column | None:
    """Search filters: a model, or equalities without the control keys."""
    if is_model(filters):
        return compile_model(compiler, filters)
    parts = [p for k, v in (filters or {}).items() if k not in CONTROL and (p := _one(compiler, k, v)) is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def options_of(model: Mapping, given: Mapping) -> dict:
    """The model's selectFields, orderBy with order, limit, skip and groupByField as options; given ones win."""
    found: dict = {}
    if model.get("selectFields"):
        found["select"] = list(model["selectFields"])
    if model.get("orderBy"):
        found["order_by"] = [{"column": model["orderBy"], "direction": model.get("order", "ASC")}]
    if model.get("limit") is not None:
        found["limit"] = int(model["limit"])
    if model.get("skip") is not None:
        found["offset"] = int(model["skip"])
    if model.get("groupByField"):
        found["group_by"] = model["groupByField"]
    return found | {k: v for k, v in given.items() if v is not None}


def split_place(model: Mapping, lat: str | None, lng: str | None) -> tuple[dict, dict | None]:
    """The model without a coordinate pair in andFilter, and that pair as a geo option of ``PLACE_KM``."""
    held = dict(model.get("andFilter") or {})
    if not (lat and lng and lat in held and lng in held):
        return dict(model), None
    centre = {"lat": float(held.pop(lat)), "lng": float(held.pop(lng))}
    return {**model, "andFilter": held}, {"center": centre, "radius": {"value": PLACE_KM, "unit": "km"}}


"""Attaching related rows along declared foreign keys, as joins of the same plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.catalog import Catalog, Edge
from quernel.plans.predicates import RELATION

Tables = Callable[[str], DataFrame]


def _name(table: str, edge: Edge, edges: list[Edge]) -> str:
    """The attached column: the table's name, with the key column where two edges lead to one table."""
    twins = [e for e in edges if (e.table, e.parent) == (edge.table, edge.parent)]
    return f"{table}_{edge.column}" if len(twins) > 1 else table


def dependents_flat(df: DataFrame, edge: Edge, child: DataFrame) -> DataFrame:
    """A row per parent and child (structs ``parent`` and ``child``, null without one): the way for parents with very many children."""
    joined = df.alias("p").join(child.alias("c"), F.col(f"p.{edge.parent_column}") == F.col(f"c.{edge.column}"), "left")
    there = F.col(f"c.{edge.column}").isNotNull()
    return joined.select(F.struct("p.*").alias("parent"), F.when(there, F.struct("c.*")).alias("child"))


def attach_dependents(df: DataFrame, edge: Edge, child: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """``df`` with an array of the child rows that refer to each row, in order of all their columns; empty if there are none.

    Only children of rows in ``df`` are grouped (left semi join), so a page of
    parents doesn't gather the whole child table. Null keys have no children.
    A parent's children are one value in one row, so they must fit a task
    (and 2 GB); ``most`` keeps the first so many of each parent, chosen before
    they are gathered, and ``dependents_flat`` gives any number as rows.
    """
    wanted = df.select(F.col(edge.parent_column).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    rows = child.alias("c").join(wanted.alias("w"), F.col(f"c.{edge.column}") == F.col("w._k"), "left_semi")
    if most is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(edge.column).orderBy(*child.columns))).where(F.col("_n") <= most).drop("_n")
    grouped = rows.groupBy(F.col(edge.column).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*child.columns))).alias("_v"))
    joined = df.drop(name).alias("p").join(grouped.alias("g"), F.col(f"p.{edge.parent_column}") == F.col("g._k"), "left")
    return joined.select("p.*", F.coalesce("g._v", F.array().cast(grouped.schema["_v"].dataType)).alias(name))


def attach_dependency(df: DataFrame, edge: Edge, parent: DataFrame, name: str) -> DataFrame:
    """``df`` with the parent row as a struct, null without one; of several parents of one key the greatest."""
    single = parent.groupBy(F.col(edge.parent_column).alias("_k")).agg(F.max(F.struct(*parent.columns)).alias("_v"))
    joined = df.drop(name).alias("c").join(single.alias("g"), F.col(f"c.{edge.column}") == F.col("g._k"), "left")
    return joined.select("c.*", F.col("g._v").alias(name))


def attach(df: DataFrame, table: str, catalog: Catalog, tables: Tables, relations: bool | Mapping, depth: int = 1) -> DataFrame:
    """All wanted relations of ``table``: True, or names under ``dependents`` and ``dependencies`` (True or a list)."""
    if not relations or depth <= 0:
        return df
    pick = {"dependents": True, "dependencies": True} if relations is True else relations
    wanted = lambda side, name: pick.get(side) is True or name in (pick.get(side) or ())
    out = df
    for edge in catalog.edges_from(table):
        if wanted("dependencies", edge.parent):
            parent = tables(edge.parent)
            if depth > 1:
                parent = attach(parent, edge.parent, catalog, tables, {"dependencies": True}, depth - 1)
            out = attach_dependency(out, edge, parent, _name(edge.parent, edge, catalog.edges))
    for edge in catalog.edges_to(table):
        if wanted("dependents", edge.table):
            child = tables(edge.table)
            if depth > 1:
                child = attach(child, edge.table, catalog, tables, {"dependents": True}, depth - 1)
            out = attach_dependents(out, edge, child, _name(edge.table, edge, catalog.edges))
    return out


def split_relation_filters(where: Mapping | None) -> tuple[dict, dict]:
    """Plain conditions, and those of the form table: {some | every | none | is | isNot: conditions}."""
    plain, relations = {}, {}
    for key, value in (where or {}).items():
        side = relations if isinstance(value, Mapping) and value and all(k in RELATION for k in value) else plain
        side[key] = value
    return plain, relations


def filter_by_relations(df: DataFrame, table: str, filters: Mapping, catalog: Catalog, tables: Tables, compile_where: Callable[[str, Mapping], Column | None]) -> DataFrame:
    """Semi and anti joins for relation filters.

    some: a child meets the conditions; none: no child does; every: no child
    fails them (a null result fails). is, isNot: the parent meets them, or not
    (a row without parent is not). Where several keys lead to the other table,
    the filter names one as table_column, as the attached columns are named.
    """
    for other, spec in filters.items():
        for op, conditions in spec.items():
            down = op in ("some", "every", "none")
            named = [(e.table if down else e.parent, e) for e in (catalog.edges_to(table) if down else catalog.edges_from(table))]
            edges = [(n, e) for n, e in named if n == other] or [(n, e) for n, e in named if _name(n, e, catalog.edges) == other]
            if not edges:
                raise ValueError(f"no relation between {table} and {other} for {op}")
            if len(edges) > 1:
                raise ValueError(f"several relations between {table} and {other}: name one of {', '.join(_name(n, e, catalog.edges) for n, e in edges)}")
            (name, edge), = edges
            rows, test = tables(name), compile_where(name, conditions)
            test = F.lit(True) if test is None else test
            rows = rows.where(~F.coalesce(test, F.lit(False)) if op == "every" else test)
            mine, theirs = (edge.parent_column, edge.column) if down else (edge.column, edge.parent_column)
            keys = rows.select(F.col(theirs).alias("_k"))
            how = "left_semi" if op in ("some", "is") else "left_anti"
            df = df.alias("d").join(keys.alias("k"), F.col(f"d.{mine}") == F.col("k._k"), how)
    return df

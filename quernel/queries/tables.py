"""Queries of filters, reads, relations, writes and telemetry, with SQL for DuckDB."""

from __future__ import annotations

import datetime
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.catalog import Catalog, Edge, Settings, TableInfo
from quernel.engine import Engine
from quernel.hooks import OPERATIONS
from quernel.operators import mutations, relations, telemetry
from quernel.operators.reads import top_per
from quernel.plans.predicates import UNSET
from quernel.queries.model import CATALOG, engine
from quernel.session import forget_at_end, new_path, table
from quernel.sources.readers import cast_read, read, write
from quernel.streaming.hourly import run_to_end, windowed_metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _where(name: str, tab: str, where: dict, select: list[str], sql: str) -> None:
    """A query that filters one table and shows some columns."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return engine(spark, d, tab).table(tab).find_many(where, select=select)

    run.__name__ = name
    run.__doc__ = f"Rows of {tab} by a filter object."
    query(f"SELECT {', '.join(select)} FROM {tab} WHERE {sql}")(run)


_O, _C, _P = ["o_orderkey", "o_orderstatus", "o_totalprice"], ["c_custkey", "c_name"], ["p_partkey", "p_name"]
_where("where_eq", "customer", {"c_mktsegment": "BUILDING"}, _C, "c_mktsegment = 'BUILDING'")
_where("where_null", "query_log", {"table_name": None}, ["id"], "table_name IS NULL")
_where("where_not_null", "query_log", {"cache_hit": {"not": None}, "filters": {"isNull": True}}, ["id"], "cache_hit IS NOT NULL AND filters IS NULL")
_where("where_in", "orders", {"o_orderstatus": ["O", "P"]}, _O, "o_orderstatus IN ('O', 'P')")
_where("where_in_empty", "orders", {"o_orderstatus": {"in": []}}, _O, "1 = 0")
_where("where_not_in", "orders", {"o_orderstatus": {"notIn": ["O", "F"]}}, _O, "o_orderstatus NOT IN ('O', 'F')")
_where("where_not_in_empty", "region", {"r_name": {"notIn": []}}, ["r_regionkey", "r_name"], "1 = 1")
_where("where_range", "orders", {"o_totalprice": {"gte": 100000, "lt": 200000}}, _O, "o_totalprice >= 100000 AND o_totalprice < 200000")
_where("where_like_contains", "part", {"p_name": {"contains": "a_e"}}, _P, "p_name LIKE '%a_e%'")
_where("where_like_starts", "services", {"title": {"startsWith": "Re"}}, ["id", "title"], "title LIKE 'Re%'")
_where("where_like_ends", "services", {"title": {"endsWith": "ing"}}, ["id", "title"], "title LIKE '%ing'")
_where("where_like_insensitive", "services", {"title": {"contains": "CLEAN", "mode": "insensitive"}}, ["id", "title"], "lower(title) LIKE '%clean%'")
_where("where_or", "orders", {"OR": [{"o_orderstatus": "P"}, {"o_totalprice": {"gt": 300000}}]}, _O, "o_orderstatus = 'P' OR o_totalprice > 300000")
_where("where_not_multi", "orders", {"NOT": [{"o_orderstatus": "O", "o_totalprice": {"gt": 50000}}]}, _O, "NOT (o_orderstatus = 'O' AND o_totalprice > 50000)")
_where("where_nested", "customer", {"AND": [{"c_acctbal": {"gte": 0}}, {"OR": [{"c_mktsegment": "BUILDING"}, {"NOT": [{"c_nationkey": {"in": [1, 2, 3]}}]}]}], "OR": []}, _C, "c_acctbal >= 0 AND (c_mktsegment = 'BUILDING' OR NOT c_nationkey IN (1, 2, 3))")
_where("where_dates", "orders", {"o_orderdate": {"gte": "1995-01-01", "lte": "1995-12-31"}}, ["o_orderkey"], "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-12-31'")
_where("where_legacy_ops", "orders", {"o_totalprice": {"$gte": 1000, "$lt": 150000}, "o_orderstatus": {"$ne": "F"}, "o_orderpriority": {"$like": "1%"}}, _O, "o_totalprice >= 1000 AND o_totalprice < 150000 AND o_orderstatus <> 'F' AND o_orderpriority LIKE '1%'")
_where("where_boolean", "services", {"is_active": True, "price": {"lte": 50}}, ["id", "price"], "is_active AND price <= 50")
_where("where_is_not_null", "query_stats", {"last_warming_time": {"isNotNull": True}, "table_name": {"equals": "bookings"}, "filters": UNSET}, ["query_id", "access_count"], "last_warming_time IS NOT NULL AND table_name = 'bookings'")
_where("where_documented_ops", "orders", {"o_orderstatus": {"$eq": "O"}, "o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}, "o_totalprice": {"$gt": 50000, "$lte": 300000}}, _O, "o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 50000 AND o_totalprice <= 300000")
_where("where_date_objects", "orders", {"o_orderdate": {"gte": datetime.datetime(1995, 1, 1), "lt": datetime.datetime(1996, 1, 1)}}, ["o_orderkey"], "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_where("filter_model_and_like_or", "services", {"andFilter": {"is_active": True, "category": None}, "likeFilter": {"title": "ing"}, "orFilter": [{"category": "Home", "price": {"maximum": 40}}]}, ["id"], "is_active AND title LIKE '%ing%' AND (category = 'Home' OR price <= 40)")
_where("filter_model_between", "products", {"andFilter": {"price": {"_type": "between", "_value": [10, 30]}, "stock_quantity": {"minimum": 5, "maximum": 90}, "name": {"_type": "find-operator", "_value": "%a%"}}}, ["id"], "price BETWEEN 10 AND 30 AND stock_quantity BETWEEN 5 AND 90 AND name LIKE '%a%'")
_where("filter_model_wildcard", "products", {"andFilter": {"category_id": [1, 2, 3, 4]}, "wildcardQueryString": "WOOL", "wildCardMatchWithFields": ["name", "description"]}, ["id"], "category_id IN (1, 2, 3, 4) AND (lower(name) LIKE '%wool%' OR lower(description) LIKE '%wool%')")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 50000 AND 250000 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def find_many_paged(spark: SparkSession, d: str) -> DataFrame:
    """The third page of orders by date."""
    where = {"o_orderstatus": {"in": ["O", "P"]}, "o_totalprice": {"gte": 50000, "lte": 250000}}
    return engine(spark, d, "orders").orders.find_many(where, ["o_orderkey", "o_totalprice"], {"column": "o_orderdate", "direction": "DESC"}, 20, 40)


@query("SELECT * FROM customer WHERE c_custkey = 7")
def find_by_id(spark: SparkSession, d: str) -> DataFrame:
    """One customer by key."""
    customer = engine(spark, d, "customer").customer
    return spark.createDataFrame([customer.find_by_id(7)], customer.df.schema)


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 1")
def find_one(spark: SparkSession, d: str) -> DataFrame:
    """The first customer of a segment by balance."""
    customer = engine(spark, d, "customer").customer
    return spark.createDataFrame([customer.find_one({"c_mktsegment": "BUILDING"}, order_by="c_acctbal DESC")], customer.df.schema)


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_returnflag <> 'N'")
def count_where(spark: SparkSession, d: str) -> DataFrame:
    """How many line items meet a filter."""
    n = engine(spark, d, "lineitem").lineitem.count({"l_quantity": {"gt": 25}, "l_returnflag": {"not": "N"}})
    return spark.createDataFrame([(n,)], "n long")


@query("SELECT *, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total, 35 < (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS has_more FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 10")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """A page with the rows of all pages."""
    return engine(spark, d, "customer").customer.page({"c_acctbal": {"gt": 0}}, "c_acctbal DESC", 25, 10)


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY n_name HAVING count(*) > 10")
def raw_having_join(spark: SparkSession, d: str) -> DataFrame:
    """Any SQL with parameters."""
    e = engine(spark, d, "customer", "nation", "orders")
    return e.raw("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > ? GROUP BY n_name HAVING count(*) > ?", [0, 10])


@query("SELECT DISTINCT p_brand FROM part")
def distinct_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values in order."""
    return table(spark, d, "part").select("p_brand").distinct().orderBy("p_brand")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def group_by_field(spark: SparkSession, d: str) -> DataFrame:
    """How often each value occurs among the filtered rows."""
    return engine(spark, d, "customer").customer.find_many({"c_acctbal": {"gt": 0}}, group_by="c_mktsegment")


@query("SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM customer QUALIFY rank <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The three richest customers of each nation."""
    return top_per(table(spark, d, "customer"), "c_nationkey", "c_acctbal", 3, ["c_custkey"]).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0) AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def rel_dependents_counts(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their orders as an array."""
    e = engine(spark, d, "customer", "orders")
    rows = e.customer.find_many(limit=-1, with_relations={"dependents": ["orders"]})
    keys = F.aggregate(F.transform("orders", lambda o: o["o_orderkey"]), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("c_custkey", F.size("orders").cast("long").alias("n"), keys.alias("keys"))


@query("SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def rel_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer as a struct."""
    rows = engine(spark, d, "customer", "orders").orders.find_many({"o_totalprice": {"gt": 200000}}, limit=-1, with_relations={"dependencies": ["customer"]})
    return rows.select("o_orderkey", "customer.c_name", "customer.c_nationkey")


@query("WITH n AS (SELECT * FROM nation ORDER BY n_name, n_nationkey LIMIT 10) SELECT n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM n JOIN region ON n_regionkey = r_regionkey")
def rel_both_limited(spark: SparkSession, d: str) -> DataFrame:
    """Ten nations with their region, customers and suppliers."""
    rows = engine(spark, d, "region", "nation", "customer", "supplier").nation.find_many(order_by="n_name", limit=10, with_relations=True)
    return rows.select("n_name", "region.r_name", F.size("customer").cast("long").alias("customers"), F.size("supplier").cast("long").alias("suppliers"))


def _related(name: str, tab: str, others: list[str], where: dict, key: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return engine(spark, d, tab, *others).table(tab).find_many(where, select=[key])

    run.__name__ = name
    run.__doc__ = f"Rows of {tab} by conditions on related rows."
    query(f"SELECT {key} FROM {tab} WHERE {sql}")(run)


_related("rel_some", "customer", ["orders"], {"orders": {"some": {"o_totalprice": {"gt": 300000}}}}, "c_custkey", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_related("rel_none", "customer", ["orders"], {"orders": {"none": {"o_orderstatus": "P"}}}, "c_custkey", "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_related("rel_every", "customer", ["orders"], {"orders": {"every": {"o_totalprice": {"lt": 250000}}}}, "c_custkey", "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice < 250000)")
_related("rel_is", "customer", ["nation"], {"nation": {"is": {"n_regionkey": 2}}}, "c_custkey", "EXISTS (SELECT 1 FROM nation WHERE c_nationkey = n_nationkey AND n_regionkey = 2)")
_related("rel_is_not", "customer", ["nation"], {"nation": {"isNot": {"n_regionkey": 2}}}, "c_custkey", "NOT EXISTS (SELECT 1 FROM nation WHERE c_nationkey = n_nationkey AND n_regionkey = 2)")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 1 + (SELECT max(r_regionkey) FROM region), 'NORTH' UNION ALL SELECT 2 + (SELECT max(r_regionkey) FROM region), 'SOUTH'")
def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table after two rows were added; keys continue."""
    e = engine(spark, d, "region")
    e.region.insert_many([{"r_name": "NORTH"}, {"r_name": "SOUTH"}])
    return e.region.df


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'WATCH' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(spark: SparkSession, d: str) -> DataFrame:
    """A table after an update."""
    e = engine(spark, d, "customer")
    e.customer.update_many({"c_acctbal": {"lt": 0}}, {"c_mktsegment": "WATCH"})
    return e.customer.df.select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT id, query_type FROM query_log WHERE NOT coalesce(table_name = 'bookings', false)")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    """A table after a delete; rows with a null stay."""
    e = engine(spark, d, "query_log")
    e.table("query_log").delete_many({"table_name": "bookings"})
    return e.table("query_log").df.select("id", "query_type")


@query("SELECT id, price FROM products WHERE category_id IN (1, 2, 3) AND price > 20 ORDER BY price DESC NULLS LAST, id LIMIT 7 OFFSET 3")
def filter_model_options(spark: SparkSession, d: str) -> DataFrame:
    """A filter model that carries its own order, page and columns."""
    model = {"andFilter": {"category_id": [1, 2, 3], "price": {"minimum": 20.01}}, "orderBy": "price", "order": "DESC", "limit": 7, "skip": 3, "selectFields": ["id", "price"]}
    return engine(spark, d, "products").products.find_many(model)


@query("WITH e AS (SELECT min((l_orderkey, l_linenumber)) AS k, max((l_orderkey, l_linenumber)) AS z FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey, l_linenumber) = k THEN 99.0 ELSE l_quantity END AS l_quantity FROM lineitem, e WHERE (l_orderkey, l_linenumber) <> z")
def by_id_writes(spark: SparkSession, d: str) -> DataFrame:
    """Line items after one was changed and one deleted by their whole keys; the other lines of the orders stay."""
    lines = engine(spark, d, "lineitem").lineitem
    key = F.struct("l_orderkey", "l_linenumber")
    low, high = lines.df.agg(F.min(key), F.max(key)).first()
    lines.update_by_id(tuple(low), {"l_quantity": 99.0})
    lines.delete_by_id(high.asDict())
    return lines.df.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 'EAST' ELSE r_name END AS r_name FROM region WHERE r_name <> 'EUROPE' UNION ALL SELECT 1 + (SELECT max(r_regionkey) FROM region), 'NORTH'")
def single_writes(spark: SparkSession, d: str) -> DataFrame:
    """A table after single rows were inserted, updated and deleted."""
    e = engine(spark, d, "region")
    e.region.insert_one({"r_name": "NORTH"})
    e.region.update_one({"r_name": "ASIA"}, {"r_name": "EAST"})
    e.region.delete_one({"r_name": "EUROPE"})
    return e.region.df


@query("""
    WITH s AS (SELECT query_id, max(access_count) AS c, max(CAST(avg_execution_time AS DOUBLE)) AS a, max(last_accessed_at) AS l FROM query_stats GROUP BY query_id),
    b AS (SELECT query_id, count(*) AS n, avg(CAST(execution_time_ms AS DOUBLE)) AS a, max(make_timestamp(logged_ms * 1000)) AS l FROM query_log WHERE query_id IS NOT NULL GROUP BY query_id)
    SELECT query_id, coalesce(s.c, 0) + coalesce(b.n, 0) AS access_count, round(CASE WHEN s.a IS NULL THEN b.a WHEN b.a IS NULL THEN s.a ELSE (s.a * coalesce(s.c, 0) + b.a * b.n) / (coalesce(s.c, 0) + b.n) END, 6) AS avg_execution_time, greatest(s.l, b.l) AS last_accessed_at FROM s FULL JOIN b USING (query_id)""")
def stats_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Running figures per query joined with a log."""
    stats = table(spark, d, "query_stats").groupBy("query_id").agg(F.max("access_count").cast("long").alias("access_count"), F.max("avg_execution_time").cast("double").alias("avg_execution_time"), F.max("last_accessed_at").alias("last_accessed_at"))
    log = table(spark, d, "query_log").where("query_id IS NOT NULL").select("query_id", "execution_time_ms", F.timestamp_millis("logged_ms").cast("timestamp_ntz").alias("accessed_at"))
    return mutations.upsert_stats(stats, log).select("query_id", "access_count", F.round("avg_execution_time", 6).alias("avg_execution_time"), "last_accessed_at")


@query("SELECT r_regionkey, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def rel_two_levels(spark: SparkSession, d: str) -> DataFrame:
    """Regions with their nations, and those with their customers."""
    rows = engine(spark, d, "region", "nation", "customer", "supplier").region.find_many(limit=-1, with_relations={"dependents": ["nation"]}, depth=2)
    customers = F.aggregate("nation", F.lit(0).cast("long"), lambda n, x: n + F.size(x["customer"]))
    return rows.select("r_regionkey", F.size("nation").cast("long").alias("nations"), customers.alias("customers"))


_ROUTES = "(SELECT s_suppkey AS id, s_nationkey AS home, CAST(s_suppkey % 25 AS INTEGER) AS goal FROM supplier)"


@query(f"SELECT n_nationkey, (SELECT count(*) FROM {_ROUTES} WHERE home = n_nationkey) AS leaving, (SELECT count(*) FROM {_ROUTES} WHERE goal = n_nationkey) AS coming FROM nation WHERE EXISTS (SELECT 1 FROM {_ROUTES} WHERE goal = n_nationkey AND id > 5)")
def rel_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """Two keys to one table: an attached column and a filter each."""
    e = Engine(spark, Catalog({"nation": TableInfo("nation", ("n_nationkey",)), "routes": TableInfo("routes", ("id",))}, [Edge("routes", c, "nation", "n_nationkey") for c in ("home", "goal")]))
    e.register("nation", table(spark, d, "nation"))
    e.register("routes", table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("home"), (F.col("s_suppkey") % 25).cast("int").alias("goal")))
    rows = e.nation.find_many({"routes_goal": {"some": {"id": {"gt": 5}}}}, limit=-1, with_relations={"dependents": ["routes"]})
    return rows.select("n_nationkey", F.size("routes_home").cast("long").alias("leaving"), F.size("routes_goal").cast("long").alias("coming"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def rel_flat(spark: SparkSession, d: str) -> DataFrame:
    """Customers and their orders as rows, for parents with any number of children."""
    edge = next(x for x in CATALOG.edges if x.table == "orders")
    return relations.dependents_flat(table(spark, d, "customer"), edge, table(spark, d, "orders")).select("parent.c_custkey", "child.o_orderkey")


@query("SELECT * FROM (VALUES ('region', 'r_regionkey', 'int', true), ('region', 'r_name', 'string', false), ('lineitem', 'l_orderkey', 'bigint', true), ('lineitem', 'l_linenumber', 'int', true)) v(table_name, column_name, data_type, is_key)")
def schema_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of two tables with their keys."""
    e = engine(spark, d, "region", "lineitem")
    both = [e.schema(n).select(F.lit(n).alias("table_name"), "column_name", "data_type", "is_key") for n in ("region", "lineitem")]
    return both[0].unionByName(both[1].where("is_key"))


@query("SELECT * FROM (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('supplier', 's_nationkey', 'nation', 'n_nationkey'), ('orders', 'o_custkey', 'customer', 'c_custkey'), ('lineitem', 'l_orderkey', 'orders', 'o_orderkey'), ('lineitem', 'l_partkey', 'part', 'p_partkey'), ('lineitem', 'l_suppkey', 'supplier', 's_suppkey')) v(from_table, from_column, to_table, to_column)")
def schema_relationships(spark: SparkSession, d: str) -> DataFrame:
    """The declared foreign keys."""
    return engine(spark, d, "region").relationships().select("from_table", "from_column", "to_table", "to_column")


@query("SELECT 'ddl' AS style, 'CREATE TABLE region (' || chr(10) || '  r_regionkey INT,' || chr(10) || '  r_name STRING,' || chr(10) || '  PRIMARY KEY (r_regionkey)' || chr(10) || ')' AS text UNION ALL SELECT 'interface', 'export interface Region {' || chr(10) || '  r_regionkey?: number | null;' || chr(10) || '  r_name?: string | null;' || chr(10) || '}'")
def schema_export(spark: SparkSession, d: str) -> DataFrame:
    """A table's schema as a statement and as an interface."""
    e = engine(spark, d, "region")
    return spark.createDataFrame([(style, e.export("region", style)) for style in ("ddl", "interface")], "style string, text string")


@query("SELECT * FROM (VALUES ('customer', 1, 'nation orders'), ('customer', 2, 'lineitem nation orders region supplier'), ('region', 1, 'nation'), ('part', 1, 'lineitem')) v(table_name, depth, reached)")
def cache_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose results go when a table is written, by depth."""
    return spark.createDataFrame([(t, n, " ".join(CATALOG.cascade(t, n))) for t, n in (("customer", 1), ("customer", 2), ("region", 1), ("part", 1))], "table_name string, depth int, reached string")


@query("SELECT * FROM (VALUES ('first', 0, 1, 1), ('again', 1, 1, 1), ('other filter', 1, 2, 2), ('past its time', 1, 3, 2), ('after a write', 1, 3, 0), ('one too many', 1, 6, 2), ('pattern', 1, 6, 0)) v(step, hits, misses, keys)")
def cache_steps(spark: SparkSession, d: str) -> DataFrame:
    """Hits, misses and kept results while a table is read, written and read again."""
    now = [0.0]
    e = Engine(spark, CATALOG, Settings(max_keys=2), clock=lambda: now[0])
    for name in ("region", "nation"):
        e.register(name, table(spark, d, name))
    told = []

    def tell(step: str) -> None:
        found = e.cache.stats()
        told.append((step, found["hits"], found["misses"], found["keys"]))

    for step in ("first", "again"):
        e.nation.find_many({"n_regionkey": 1}, cache=True, ttl=50)
        tell(step)
    e.nation.find_many({"n_regionkey": 2}, cache=True)
    tell("other filter")
    now[0] = 55.0
    e.nation.find_many({"n_regionkey": 1}, cache=True, ttl=50)
    tell("past its time")
    e.region.update_many({"r_regionkey": 1}, {"r_name": "WEST"})
    tell("after a write")
    for key in (1, 2, 3):
        e.nation.find_many({"n_regionkey": key}, cache=True)
    tell("one too many")
    e.cache.delete_pattern("nation:*")
    tell("pattern")
    return spark.createDataFrame(told, "step string, hits int, misses int, keys int")


@query("SELECT operation, CASE WHEN operation = 'findMany' THEN 2 ELSE 1 END AS before, CASE WHEN operation = 'findMany' THEN 2 ELSE 1 END AS after FROM (SELECT unnest(['findOne', 'findMany', 'findById', 'count', 'insertOne', 'insertMany', 'updateOne', 'updateMany', 'updateById', 'deleteOne', 'deleteMany', 'deleteById', 'raw', 'search']) AS operation)")
def hooks_fired(spark: SparkSession, d: str) -> DataFrame:
    """How often the hooks of each operation run when each is called once (findOne reads by findMany)."""
    e = engine(spark, d, "part", "region")
    seen: Counter = Counter()
    for operation in OPERATIONS:
        name = "*" if operation == "raw" else "part" if operation == "search" else "region"
        e.hooks.before(name, operation, lambda value, o=operation: seen.update([("before", o)]))
        e.hooks.after(name, operation, lambda value, o=operation: seen.update([("after", o)]))
    r = e.region
    r.find_one({"r_regionkey": 1}), r.find_many({"r_regionkey": 1}), r.find_by_id(1), r.count()
    r.insert_one({"r_name": "A"}), r.insert_many([{"r_name": "B"}]), r.update_one({"r_name": "A"}, {"r_name": "C"}), r.update_many({"r_name": "B"}, {"r_name": "D"}), r.update_by_id(1, {"r_name": "E"})
    r.delete_one({"r_name": "C"}), r.delete_many({"r_name": "D"}), r.delete_by_id(1), e.raw("SELECT 1"), e.part.search("steel")
    return spark.createDataFrame([(o, seen["before", o], seen["after", o]) for o in OPERATIONS], "operation string, before int, after int")


@query("SELECT * FROM (VALUES ('orders', 'findMany', 3), ('orders', 'count', 1), ('orders', 'findById', 1)) v(table_name, query_type, n)")
def log_kept(spark: SparkSession, d: str) -> DataFrame:
    """The log of an engine's own queries, of one request only."""
    e = engine(spark, d, "orders")
    e.orders.find_many({"o_orderstatus": "O"}, limit=1)
    e.clear_queries()
    for _ in range(2):
        e.orders.find_many({"o_orderdate": {"gte": datetime.datetime(1995, 1, 1)}}, limit=1)
    e.orders.count()
    e.orders.find_by_id(1)
    e.orders.find_many(limit=1)
    return e.log().groupBy("table_name", "query_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 2 AS warmed, '0.00%' AS hit_rate_before, '50.00%' AS hit_rate_after, 3 AS first_page")
def cache_warmed(spark: SparkSession, d: str) -> DataFrame:
    """The most asked queries kept ahead, filters with dates among them; a second run finds them kept."""
    e = engine(spark, d, "orders")
    for _ in range(2):
        e.orders.find_many({"o_orderdate": {"gte": datetime.datetime(1995, 1, 1)}}, limit=5)
        e.orders.find_many({"o_orderstatus": ["O", "P"]}, limit=5)
    first = e.warm(limit=2, at_least=2)
    e.warm(limit=2, at_least=2)
    return spark.createDataFrame([(first["warmed"], first["hit_rate_before"], e.cache.stats()["hit_rate"], e.orders.warm_cache(limit=3))], "warmed int, hit_rate_before string, hit_rate_after string, first_page int")


@query("SELECT table_name, query_type, filters, count(*) AS access_count, round(avg(CAST(execution_time_ms AS DOUBLE)), 6) AS avg_execution_time, max(logged_ms) AS last_accessed_ms FROM query_log GROUP BY ALL")
def access_record(spark: SparkSession, d: str) -> DataFrame:
    """Accesses, mean time and last access per query as it is written in the log."""
    return telemetry.access_stats(table(spark, d, "query_log"), F.col("filters")).withColumn("avg_execution_time", F.round("avg_execution_time", 6))


@query("""
    WITH t AS (SELECT table_name, query_type, CASE query_type WHEN 'findMany' THEN 'select * from `' || table_name || '` where a = 1' WHEN 'findOne' THEN ' INSERT INTO ' || table_name || ' VALUES (1)'
        WHEN 'findById' THEN 'Update ' || table_name || ' set a = 1' WHEN 'count' THEN 'DELETE FROM ' || table_name ELSE 'create table if not exists ' || table_name || ' (a int)' END AS s FROM query_log WHERE table_name IS NOT NULL)
    SELECT CASE query_type WHEN 'findMany' THEN 'SELECT' WHEN 'findOne' THEN 'INSERT' WHEN 'findById' THEN 'UPDATE' WHEN 'count' THEN 'DELETE' ELSE 'CREATE' END AS kind, table_name, count(*) AS n FROM t GROUP BY ALL""")
def statement_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kind and table read back from statements made of the log's rows."""
    t, kind = F.col("table_name"), F.col("query_type")
    made = F.when(kind == "findMany", F.concat(F.lit("select * from `"), t, F.lit("` where a = 1"))).when(kind == "findOne", F.concat(F.lit(" INSERT INTO "), t, F.lit(" VALUES (1)"))).when(kind == "findById", F.concat(F.lit("Update "), t, F.lit(" set a = 1")))
    made = made.when(kind == "count", F.concat(F.lit("DELETE FROM "), t)).otherwise(F.concat(F.lit("create table if not exists "), t, F.lit(" (a int)")))
    rows = table(spark, d, "query_log").where(t.isNotNull()).select(made.alias("s")).select(telemetry.statement_kind(F.col("s")).alias("kind"), telemetry.statement_table(F.col("s")).alias("table_name"))
    return rows.groupBy("kind", "table_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, n_nationkey, n_name, n_regionkey FROM nation, (SELECT unnest(['parquet', 'orc', 'json', 'csv']) AS kind)")
def read_formats(spark: SparkSession, d: str) -> DataFrame:
    """A table written and read again in each format."""
    nation, out = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), None
    for kind in ("parquet", "orc", "json", "csv"):
        path = new_path(spark, kind)
        write(nation, path, kind)
        forget_at_end(spark, path)
        part = read(spark, path, kind, "n_nationkey int, n_name string, n_regionkey int").withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


_LOG = "FROM query_log"
_MS = "CAST(execution_time_ms AS DOUBLE)"


@query(f"SELECT count(*) AS total, round(avg({_MS}), 9) AS mean_ms, min({_MS}) AS min_ms, max({_MS}) AS max_ms, count(*) FILTER (cache_hit) AS hits, count(*) FILTER (NOT cache_hit) AS misses, round(100.0 * count(*) FILTER (cache_hit) / count(cache_hit), 2) AS hit_percent {_LOG} WHERE logged_ms >= (SELECT max(logged_ms) FROM query_log) - 86400000")
def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the log's last day."""
    log = table(spark, d, "query_log")
    rows = log.where(F.col("logged_ms") >= log.agg(F.max("logged_ms")).scalar() - 86_400_000)
    return telemetry.summary(rows).withColumn("mean_ms", F.round("mean_ms", 9))


@query(f"SELECT query_type, count(*) AS n, round(avg({_MS}), 9) AS mean_ms {_LOG} GROUP BY query_type")
def metrics_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Count and mean time per type."""
    return telemetry.by_column(table(spark, d, "query_log"), "query_type").withColumn("mean_ms", F.round("mean_ms", 9))


@query(f"SELECT table_name, count(*) AS n, round(avg({_MS}), 9) AS mean_ms {_LOG} GROUP BY table_name ORDER BY n DESC, table_name NULLS FIRST LIMIT 10")
def metrics_by_table(spark: SparkSession, d: str) -> DataFrame:
    """The ten busiest tables."""
    return telemetry.by_column(table(spark, d, "query_log"), "table_name", 10).withColumn("mean_ms", F.round("mean_ms", 9))


@query(f"SELECT date_trunc('hour', make_timestamp(logged_ms * 1000)) AS hour, count(*) AS n, round(avg({_MS}), 9) AS mean_ms, count(*) FILTER (cache_hit) AS hits {_LOG} GROUP BY 1")
def metrics_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean time and hits per hour."""
    return telemetry.hourly(table(spark, d, "query_log")).withColumn("mean_ms", F.round("mean_ms", 9))


@query(f"SELECT id, {_MS} AS ms {_LOG} WHERE table_name = 'bookings' ORDER BY execution_time_ms DESC NULLS LAST, id LIMIT 10")
def slow_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The slowest queries of a table."""
    return telemetry.slow(table(spark, d, "query_log"), 10, "bookings").select("id", F.col("execution_time_ms").cast("double").alias("ms"))


@query(f"SELECT CASE WHEN {_MS} < 10 THEN 'very fast' WHEN {_MS} < 50 THEN 'fast' WHEN {_MS} < 200 THEN 'good' WHEN {_MS} < 500 THEN 'slow' WHEN {_MS} IS NOT NULL THEN 'very slow' END AS band, count(*) AS n {_LOG} GROUP BY 1")
def speed_bands(spark: SparkSession, d: str) -> DataFrame:
    """Queries per speed band."""
    return table(spark, d, "query_log").groupBy(telemetry.speed_band(F.col("execution_time_ms")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS total, round(avg({_MS}), 9) AS mean_ms, min({_MS}) AS min_ms, max({_MS}) AS max_ms, round(100.0 * count(*) FILTER (execution_time_ms >= 1000) / count(*), 2) AS failed_percent {_LOG}")
def metrics_failures(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the log with the share of slow queries counted as failures."""
    return telemetry.metrics(table(spark, d, "query_log"), F.col("execution_time_ms") >= 1000).withColumn("mean_ms", F.round("mean_ms", 9))


@query("""
    SELECT table_name, query_id, access_count, last_accessed_at, row_number() OVER (PARTITION BY table_name ORDER BY access_count DESC, avg_execution_time NULLS LAST, query_id) AS rank
    FROM (SELECT DISTINCT query_id, table_name, access_count, last_accessed_at, avg_execution_time FROM query_stats)
    WHERE access_count >= 5 AND last_accessed_at >= TIMESTAMP '2023-01-08 22:00:00' QUALIFY rank <= 3""")
def top_queries_per_table(spark: SparkSession, d: str) -> DataFrame:
    """The most accessed recent queries of each table."""
    stats = table(spark, d, "query_stats").select("query_id", "table_name", "access_count", "last_accessed_at", "avg_execution_time").distinct()
    found = telemetry.top_queries(stats, F.lit("2023-01-09 00:00:00").cast("timestamp_ntz"), 3, 5, 7200)
    return found.select("table_name", "query_id", "access_count", "last_accessed_at", "rank")


@query("SELECT count(*) AS queries, sum(access_count) AS accesses, count(DISTINCT table_name) AS tables, round(avg(CAST(avg_execution_time AS DOUBLE)), 9) AS mean_ms FROM query_stats")
def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the kept figures."""
    return telemetry.stats_summary(table(spark, d, "query_stats")).withColumn("mean_ms", F.round("mean_ms", 9))


@query("SELECT DISTINCT table_name FROM query_stats WHERE table_name IS NOT NULL")
def tracked_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables with kept figures."""
    return telemetry.tracked_tables(table(spark, d, "query_stats"))


@query("SELECT query_id, table_name FROM query_stats WHERE last_accessed_at >= TIMESTAMP '2023-01-08 00:00:00'")
def stats_clean(spark: SparkSession, d: str) -> DataFrame:
    """Kept figures of the last day."""
    return telemetry.without_old(table(spark, d, "query_stats"), F.lit("2023-01-09 00:00:00").cast("timestamp_ntz")).select("query_id", "table_name")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_read(spark: SparkSession, d: str) -> DataFrame:
    """Text that holds JSON, parsed when read."""
    return cast_read(table(spark, d, "events"), json=["props"]).select("event_id", F.try_variant_get("props_json", "$.k", "long").alias("k"))


@query("SELECT 'customer' AS table_name, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'orders', (SELECT count(*) FROM orders)")
def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table."""
    return engine(spark, d, "customer", "nation", "orders").table_sizes()


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly figures of the events read as a stream: every window that closed before the stream's end."""
    schema, at, out = table(spark, d, "events").schema, new_path(spark, "stream"), new_path(spark, "hourly")
    stream = windowed_metrics(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d), "ts", "event_type", "value")
    run_to_end(stream, out, at)
    for path in (at, out):
        forget_at_end(spark, path)
    return spark.read.schema(stream.schema).parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "most")

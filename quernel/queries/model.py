"""The catalog of the test tables, and an engine over a data directory."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quernel.catalog import Catalog, Edge, TableInfo
from quernel.engine import Engine
from quernel.session import table

CATALOG = Catalog(
    {
        "region": TableInfo("region", ("r_regionkey",)),
        "nation": TableInfo("nation", ("n_nationkey",)),
        "customer": TableInfo("customer", ("c_custkey",)),
        "supplier": TableInfo("supplier", ("s_suppkey",)),
        "part": TableInfo("part", ("p_partkey",), (("p_name", 3.0), ("p_type", 2.0), ("p_brand", 1.0))),
        "orders": TableInfo("orders", ("o_orderkey",)),
        "lineitem": TableInfo("lineitem", ("l_orderkey", "l_linenumber")),
        "events": TableInfo("events", ("event_id",), json_columns=("props",)),
        "documents": TableInfo("documents", ("doc_id",), (("text", 1.0),)),
        "services": TableInfo("services", ("id",), (("title", 3.0), ("category", 2.0), ("description", 1.0)), "stemming"),
        "products": TableInfo("products", ("id",), (("name", 2.0), ("description", 1.0))),
        "query_log": TableInfo("query_log", ("id",)),
        "query_stats": TableInfo("query_stats", ("query_id",)),
        "geo_documents": TableInfo("geo_documents", ("geo_id",), (("location_name", 1.0),), lat="lat", lng="lng", place="location_name"),
    },
    [
        Edge("nation", "n_regionkey", "region", "r_regionkey"),
        Edge("customer", "c_nationkey", "nation", "n_nationkey"),
        Edge("supplier", "s_nationkey", "nation", "n_nationkey"),
        Edge("orders", "o_custkey", "customer", "c_custkey"),
        Edge("lineitem", "l_orderkey", "orders", "o_orderkey"),
        Edge("lineitem", "l_partkey", "part", "p_partkey"),
        Edge("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ],
)


def engine(spark: SparkSession, d: str, *names: str) -> Engine:
    """An engine with the named tables; geo_documents with lat and lng as columns."""
    out = Engine(spark, CATALOG)
    for name in names:
        df = table(spark, d, name)
        if name == "geo_documents":
            df = df.select("*", "location.lat", "location.lng").drop("location")
        out.register(name, df)
    return out

"""The engine over small tables: reads, relations, writes, cache, hooks, log, search and places."""

from __future__ import annotations

import datetime
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quernel.cache import Cache, cache_key, parse_key
from quernel.catalog import Catalog, Edge, Settings, TableInfo, ddl, interface
from quernel.engine import Engine, clear_engine, create_engine, get_engine
from quernel.functions import geo as G
from quernel.functions import score as S
from quernel.functions import text as T
from quernel.operators import cluster, geosearch, index, mutations, places, relations
from quernel.operators.telemetry import statement_kind, statement_table
from quernel.session import new_path
from quernel.sources.readers import cast_read, read, read_database, write

CATALOG = Catalog(
    {"users": TableInfo("users", ("id",), (("name", 2.0), ("bio", 1.0)), lat="lat", lng="lng"), "orders": TableInfo("orders", ("id",)), "items": TableInfo("items", ("id",))},
    [Edge("orders", "user_id", "users", "id"), Edge("items", "order_id", "orders", "id"), Edge("users", "manager_id", "users", "id")],
)


class Clock:
    now = 0.0

    def __call__(self) -> float:
        return self.now


@pytest.fixture()
def engine(spark):
    made = Engine(spark, CATALOG, clock=Clock())
    made.register("users", spark.createDataFrame([(1, "Ann Lee", "likes walking dogs", None, 40.71, -74.0), (2, "Bob", "walks cats, walks dogs", 1, 34.05, -118.24), (3, "Cy", None, 1, None, None)], "id long, name string, bio string, manager_id long, lat double, lng double"))
    made.register("orders", spark.createDataFrame([(10, 1, 5.0), (11, 1, 7.0), (12, None, 1.0)], "id long, user_id long, total double"))
    made.register("items", spark.createDataFrame([(100, 10)], "id long, order_id long"))
    return made


def test_access_and_schema(engine):
    assert engine.users.df is engine("users").df and engine["users"].name == engine.table("users").name
    with pytest.raises(AttributeError):
        engine.nothing
    with pytest.raises(KeyError):
        engine.table("nothing")
    assert engine.schema("users").where("is_key").first().column_name == "id"
    assert {(r.table_name, r.n) for r in engine.table_sizes().collect()} == {("users", 3), ("orders", 3), ("items", 1)}
    assert "PRIMARY KEY (id)" in engine.export("orders") and "userId" not in engine.export("orders", "ts")
    assert engine.relationships().count() == 3 and engine.health() == {"session": True}


def test_reads(engine):
    assert engine.users.find_one({"name": "Bob"}).id == 2 and engine.users.find_one({"name": "Zed"}) is None
    assert engine.users.find_by_id(3).name == "Cy" and engine.users.count({"manager_id": 1}) == 2
    assert [r.id for r in engine.users.find_many(order_by="manager_id DESC, id", limit=2, offset=1).collect()] == [3, 1]
    assert engine.users.find_many(select=["name"]).columns == ["name"]
    page = engine.users.page(order_by="id", limit=2).collect()
    assert [(r.id, r.total, r.has_more) for r in page] == [(1, 3, True), (2, 3, True)]
    for wrong in ({"select": ["x"]}, {"order_by": "x"}, {"order_by": "id SIDEWAYS"}):
        with pytest.raises(ValueError):
            engine.users.find_many(**wrong).collect()
    assert engine.raw("SELECT count(*) AS n FROM users WHERE id > ?", [1]).first().n == 2


def test_relations(engine):
    rows = {r.id: r for r in engine.users.find_many(with_relations=True).collect()}
    assert [o.id for o in rows[1].orders] == [10, 11] and rows[2].orders == []
    nested = {r.id: r for r in engine.users.find_many(with_relations={"dependents": ["orders"]}, depth=2).collect()}
    assert [len(o["items"]) for o in nested[1].orders] == [1, 0]
    orders = {r.id: r for r in engine.orders.find_many(with_relations={"dependencies": ["users"]}).collect()}
    assert orders[10].users.name == "Ann Lee" and orders[12].users is None
    ids = lambda where: sorted(r.id for r in engine.users.find_many(where).collect())
    assert ids({"orders": {"some": {"total": {"gt": 6}}}}) == [1]
    assert ids({"orders": {"none": {"total": {"gt": 6}}}}) == [2, 3]
    assert ids({"orders": {"every": {"total": {"gt": 6}}}}) == [2, 3]
    assert [r.id for r in engine.orders.find_many({"users": {"is": {"name": "Ann Lee"}}}).collect()] == [10, 11]
    assert [r.id for r in engine.orders.find_many({"users": {"isNot": {"name": "Ann Lee"}}}).collect()] == [12]
    with pytest.raises(ValueError):
        engine.items.find_many({"users": {"is": {}}})


def test_writes(engine):
    assert engine.orders.insert_one({"total": 2.0}).id == 13
    assert [r.id for r in engine.orders.insert_many([{"id": 50, "total": 1.0}, {"id": None, "total": 2.0}]).collect()] == [50, 14]
    assert engine.orders.insert_many([]).count() == 0
    assert engine.orders.update_many({"total": {"lt": 3}}, {"user_id": 2}) == 4
    assert engine.orders.find_by_id(12).user_id == 2
    assert engine.orders.update_one({"id": 99}, {"total": 0}) is None
    assert engine.orders.update_by_id(50, {"total": "9.5"}).total == 9.5
    assert engine.orders.delete_one({"total": {"gt": 9}}) and not engine.orders.delete_by_id(77)
    assert engine.orders.delete_many({"user_id": 2}) == 3 and engine.orders.count() == 2
    for wrong in (lambda: engine.orders.update_many({}, {"total": 1}), lambda: engine.orders.delete_many(None), lambda: engine.orders.insert_one({"x": 1}), lambda: engine.orders.update_by_id(10, {"total": "much"})):
        with pytest.raises(ValueError):
            wrong()
    assert engine.orders.delete_many(None, all_rows=True) == 2 and engine.spark.table("orders").count() == 0


def test_composite_keys(spark):
    made = Engine(spark, Catalog({"lines": TableInfo("lines", ("a", "b"))}))
    made.register("lines", spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "a long, b long, c string"))
    assert made.lines.update_by_id((1, 2), {"c": "new"}).c == "new" and made.lines.update_by_id((9, 9), {"c": "new"}) is None
    assert made.lines.update_by_id({"b": 1, "a": 2}, {"b": 5}).b == 5
    assert made.lines.delete_by_id((1, 1)) and not made.lines.delete_by_id((1, 1)) and made.lines.find_by_id((1, 2)).c == "new"
    for wrong in (1, (1,), (1, 2, 3), {"a": 1}, {"a": 1, "c": 2}):
        for write in (made.lines.delete_by_id, made.lines.find_by_id, lambda v: made.lines.update_by_id(v, {"c": "q"})):
            with pytest.raises(ValueError):
                write(wrong)
    assert made.lines.insert_one({"a": 7, "b": 8}).b == 8
    assert sorted((r.a, r.b, r.c) for r in made.lines.df.collect()) == [(1, 2, "new"), (2, 5, "z"), (7, 8, None)]


def test_upsert(spark):
    stats = spark.createDataFrame([("a", 3, 10.0, 5)], "query_id string, access_count long, avg_execution_time double, last_accessed_at long")
    log = spark.createDataFrame([("a", 20.0, 9), ("b", None, 2), ("b", 4.0, 1)], "query_id string, execution_time_ms double, accessed_at long")
    assert {tuple(r) for r in mutations.upsert_stats(stats, log).collect()} == {("a", 4, 12.5, 9), ("b", 2, 4.0, 2)}


def test_cache(engine):
    first = engine.users.find_many({"id": 1}, cache=True)
    assert engine.users.find_many({"id": 1}, cache=True) is first and engine.users.find_many({"id": 2}, cache=True) is not first
    assert engine.cache.stats()["hits"] == 1 and engine.cache.stats()["keys_by_table"] == {"users": 2}
    engine.orders.insert_one({"total": 1.0})
    assert engine.cache.stats()["keys"] == 0
    engine.users.find_many({"id": 1}, cache=True, ttl=5)
    engine.cache.clock.now = 6
    assert engine.users.find_many({"id": 1}, cache=True, ttl=5) is not first
    log = engine.log().collect()
    assert [r.cache_hit for r in log if r.query_type == "findMany"] == [False, True, False, False, False]
    engine.orders.find_many({"total": {"gte": 1}, "id": [10, 11]})
    assert engine.warm()["warmed"] == 3 and engine.users.warm_cache(with_relations=True) == 3
    engine.clear_queries()
    assert engine.log().count() == 0


def test_warming_runs_by_itself(spark):
    made = Engine(spark, CATALOG)
    made.register("orders", spark.createDataFrame([(1, datetime.datetime(2024, 1, 5))], "id long, at timestamp_ntz"))
    made.orders.find_many({"at": {"gte": datetime.datetime(2024, 1, 1)}})
    made.start_warming(every=0.05)
    for _ in range(200):
        if made.cache.stats()["keys"]:
            break
        time.sleep(0.1)
    made.close()
    assert made._warming is None
    hits = made.cache.stats()["hits"]
    assert made.warm()["warmed"] >= 1 and made.cache.stats()["hits"] >= hits


def test_cache_rules():
    catalog, clock = Catalog({}, [Edge("b", "x", "a", "id"), Edge("c", "x", "b", "id"), Edge("d", "x", "c", "id"), Edge("a", "x", "a", "id")]), Clock()
    assert catalog.cascade("a", 1) == ["b"] and catalog.cascade("a", 3) == ["b", "c", "d"] and catalog.cascade("a", 0) == []
    assert catalog.dependents("a") == ["a", "b"] and catalog.dependencies("c") == ["b"]
    cache = Cache(catalog, Settings(max_keys=2), clock)
    keys = [cache_key(t, "count", {"where": {"id": i}}) for i, t in enumerate("abz")]
    assert len(set(keys)) == 3 and cache_key("a", "o", {"x": 1, "y": 2}) == cache_key("a", "o", {"y": 2, "x": 1}) and parse_key(keys[0])["table"] == "a"
    for key, t in zip(keys, "abz"):
        cache.put(key, t, [t])
    assert not cache.exists(keys[0]) and cache.stats()["evictions"] == 1
    assert cache.invalidate("d") == 1 and cache.exists(keys[2]) and cache.delete_pattern("z:*") == 1 and cache.ttl("none") is None
    assert Cache(catalog, Settings(strategy="ttl_only")).invalidate("a") == 0


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"defaultTtl": 5, "include_tables": ["a"]}))
    found = Settings.load(str(path), {"QUERNEL_MAX_KEYS": "7", "QUERNEL_CASE_CONVERSION": "true"})
    assert (found.default_ttl, found.max_keys, found.case_conversion, found.include_tables) == (5.0, 7, True, ("a",))
    assert Catalog().visible(["a", "b"], found) == ["a"]
    for wrong in ({"QUERNEL_STRATEGY": "never"}, {"QUERNEL_MAX_KEYS": "many"}, {"QUERNEL_MAX_DEPTH": "-1"}):
        with pytest.raises(ValueError):
            Settings.load(None, wrong)
    path.write_text('{"colour": 1}')
    with pytest.raises(ValueError):
        Settings.load(str(path), {})


def test_hooks(engine):
    seen = []
    engine.hooks.before("users", "findMany", lambda where: {**(where or {}), "id": 2})
    engine.hooks.after("users", "findMany", lambda rows: seen.append(rows.count()))
    engine.hooks.after("users", "findMany", lambda rows: 1 / 0)
    assert [r.id for r in engine.users.find_many().collect()] == [2] and seen == [1]
    assert engine.hooks.listed() == [("users", "findMany", "after", 2), ("users", "findMany", "before", 1)]
    engine.hooks.remove("users")
    assert engine.users.find_many().count() == 3

    def refuse(_):
        raise PermissionError("no")

    engine.hooks.before("users", "deleteMany", refuse)
    with pytest.raises(PermissionError):
        engine.users.delete_many({"id": 1})
    with pytest.raises(ValueError):
        engine.hooks.before("users", "explode", refuse)


def test_search(engine):
    assert engine.users.build_search_index().first().documents == 3
    rows = engine.users.search("dogs", highlight_fields=["bio"]).collect()
    assert [r.id for r in rows] == [2, 1] and rows[0].highlights["bio"] == "walks cats, walks <mark>dogs</mark>"
    assert [r.id for r in engine.users.search("walks dogs").collect()] == [2] and engine.users.search("the of").count() == 0
    assert [r.id for r in engine.users.search("dogs", filters={"id": 1}, limit=1).collect()] == []
    assert [r.id for r in engine.users.search("dogs", filters={"id": 1}, limit=1, prefilter=True).collect()] == [1]
    engine.users.delete_by_id(2)
    assert [r.id for r in engine.users.search("dogs", rank="bm25").collect()] == [1]
    near = engine.users.search("ann", geo={"locationName": "the big apple"}).collect()
    assert [r.id for r in near] == [1] and near[0].score > 0.8
    assert engine.build_all_indexes() == {}
    assert engine.users.has_search_index() and engine.users.clear_search_index() and not engine.users.clear_search_index()
    assert [r.id for r in engine.users.search("doggs", fuzzy=1).collect()] == [1] and engine.users.search("doggs").count() == 0
    assert [r.id for r in engine.users.search("dogs", rank="combined").collect()] == [1]
    assert [r.doc_id for r in engine.users.documents_with("dogs").collect()] == [1]
    assert [r.term for r in engine.users.indexed_terms(0).collect()] == ["ann", "dogs", "lee", "likes", "walking"]
    with pytest.raises(ValueError):
        engine.users.search("dogs", rank="luck")
    with pytest.raises(ValueError):
        engine.orders.build_search_index()


def test_alternatives(spark):
    rows = spark.createDataFrame([(1, "colour color colors"), (2, "colour cat"), (3, "colon cat cat")], "id long, t string")
    made = index.write(rows, "id", {"t": 2.0}, "simple", new_path(spark, "index"))
    assert made.stats.first().asDict() == {"documents": 3, "terms": 5, "tokens": 7} and made.total == 3 and made.mean_length == 8 / 3
    wide = index.alternatives(made, ["color"], 1)
    assert {(r.doc_id, r.tf, r.score) for r in wide.postings.collect()} == {(1, 3, 6.0), (2, 1, 2.0), (3, 1, 2.0)}
    assert index.mean_boost({"a": 3.0, "b": None}) == 2.0 and index.mean_boost({}) == 1.0
    plan = index.bm25_scores(made, ["cat"])._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "split(" not in plan and "PushedFilters" in plan


def test_geo_index_on_built_buckets(spark):
    points = [(i, 48.0 + i % 4 * 0.001, 2.0, "Paris") for i in range(24)] + [(99, 10.0, 10.0, "X"), (100, None, 1.0, None)]
    made = Engine(spark, Catalog({"spots": TableInfo("spots", ("id",), lat="lat", lng="lng", place="name")}))
    made.register("spots", spark.createDataFrame(points, "id long, lat double, lng double, name string"))
    with pytest.raises(ValueError):
        made.spots.geo_buckets()
    found = made.spots.build_geo_buckets()
    assert sorted(r.ord for r in found.collect()) == list(range(found.count())) and made.spots.geo_buckets() is found
    rows = {r.id: r for r in made.spots.build_geo_index().collect()}
    assert len(rows) == 25 and rows[0].bucket_id is not None and rows[99].bucket_id is None and rows[5].canonical == "Paris"
    totals = made.spots.geo_stats().first()
    assert (totals.documents, totals.in_buckets, totals.south, totals.east) == (25, 24, -90.0, 180.0)
    assert {r.id for r in made.spots.search_geo({"bucketId": rows[0].bucket_id}).collect()} >= {0}
    made.spots.delete_by_id(0)
    with pytest.raises(ValueError):
        made.spots.geo_buckets()
    assert made.spots.geo_stats().first().in_buckets == 23 and made.spots.clear_geo_index() and not made.spots.clear_geo_index()


@pytest.mark.parametrize("boxed", [False, True])
def test_many_buckets_give_the_same(spark, boxed):
    draw = random.Random(4)
    spots = [(90.0, 0.0), (-89.99, 100.0), (10.0, 179.999), (10.0, -179.999), (0.0, 0.0), (48.0, 2.0)]
    around = lambda: tuple(max(-lim, min(lim, c + draw.gauss(0, 0.5))) for c, lim in zip(draw.choice(spots), (90.0, 180.0)))
    points = [(i, *around()) for i in range(300)] + [(300 + i, 48.0, 2.0) for i in range(50)] + [(900, None, 1.0), (901, 95.0, 1.0), (None, 48.0, 2.0)]
    held = [(i, f"b{i}", *around(), draw.choice([0.0, 5.0, 40.0, 300.0, 15000.0 if i > 50 else 20.0])) for i in range(60)]
    frame = spark.createDataFrame(points, "id long, lat double, lng double")
    buckets = spark.createDataFrame(held, "ord int, bucket_id string, lat double, lng double, radius_km double")
    if boxed:
        buckets = buckets.select("*", (F.col("lat") - 0.3).alias("south"), (F.col("lng") - 0.4).alias("west"), (F.col("lat") + 0.3).alias("north"), (F.col("lng") + F.col("ord") % 2 * 40).alias("east"))
    few, many = (sorted(((r.id or -1, r.lat or 0.0, r.bucket_id) for r in places.first_bucket(frame, "id", "lat", "lng", buckets, most=n).collect()), key=repr) for n in (1000, 5))
    assert few == many and len({b for _, _, b in few}) > 5


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(1000).select(F.col("id").cast("int").alias("ID"), (F.col("id") * 2).cast("int").alias("V")).write.format("jdbc").options(url=url, dbtable="T", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    found = read_database(spark, url, "T", "ID", 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert found.rdd.getNumPartitions() == 4 and found.agg(F.sum("V")).first()[0] == 999 * 1000
    assert max(found.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 260


def test_shared_folder(spark, monkeypatch):
    from quernel import session

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://there:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        session.shared_dir(Elsewhere)


def test_relations_by_column(spark):
    made = Engine(spark, Catalog({"p": TableInfo("p", ("id",)), "c": TableInfo("c", ("id",))}, [Edge("c", k, "p", "id") for k in ("x", "y")]))
    made.register("p", spark.createDataFrame([(1,), (2,)], "id long"))
    made.register("c", spark.createDataFrame([(1, 1, 2), (2, 1, None), (3, 1, 2)], "id long, x long, y long"))
    with pytest.raises(ValueError):
        made.p.find_many({"c": {"some": {"id": 1}}})
    assert [r.id for r in made.p.find_many({"c_y": {"some": {"id": 1}}}).collect()] == [2]
    assert [r.id for r in made.c.find_many({"p_x": {"is": {"id": 1}}}).collect()] == [1, 2, 3]
    edge = made.catalog.edges[0]
    few = relations.attach_dependents(made.p.df, edge, made.c.df, "c", most=2).collect()
    assert {r.id: [x.id for x in r.c] for r in few} == {1: [1, 2], 2: []}
    flat = relations.dependents_flat(made.p.df, edge, made.c.df).collect()
    assert sorted((r.parent.id, r.child and r.child.id or 0) for r in flat) == [(1, 1), (1, 2), (1, 3), (2, 0)]


def test_scores(spark):
    row = spark.range(1).select(
        S.simple_score([F.lit("C++ and c"), F.lit(None).cast("string")], "c++ c").alias("odd"),
        S.simple_score([F.lit("x")], "  ").alias("none"),
        S.snippet(F.lit("word " * 60 + "target " + "tail " * 60), ["target"], 60).alias("cut"),
        S.snippet(F.lit("short"), ["zzz"]).alias("start"),
        S.snippet(F.lit(None).cast("string"), ["a"]).alias("null"),
        S.highlight(F.lit("a.b axb A.B"), ["a.b"]).alias("marked"),
        F.transform(T.simple_tokens(F.lit("The cat, the café cat! 42 ok")), lambda t: F.concat_ws(":", t["pos"], t["term"])).alias("tokens"),
        F.transform(T.ngram_tokens(F.lit("ab abcd")), lambda t: t["term"]).alias("grams"),
    ).first()
    assert row.odd == 1.25 and row.none == 0 and row.start == "short" and row["null"] == ""
    assert row.cut.startswith("...") and row.cut.endswith("...") and "<mark>target</mark>" in row.cut and len(row.cut) < 80
    assert row.marked == "<mark>a.b</mark> axb <mark>A.B</mark>"
    assert row.tokens == ["1:cat", "3:café", "4:cat"] and row.grams == ["abc", "bcd"]


def test_places_and_clusters(spark):
    points = spark.createDataFrame([(i, 48.0 + i % 3 * 0.001, 2.0, "Paris") for i in range(40)] + [(99, 10.0, 10.0, "X"), (100, None, 1.0, None)], "id long, lat double, lng double, name string")
    found = cluster.buckets(points, "id", "lat", "lng", "name").collect()
    assert sum(r.n for r in found) == 40 and {r.location_name for r in found} == {"paris"} and sorted(m for r in found for m in r.members) == sorted(str(i) for i in range(40))
    assert all(math.isclose(r.radius_km, 1.1 * max(0.0, r.radius_km / 1.1)) for r in found)
    assert cluster.buckets(points.limit(0), "id", "lat", "lng").count() == 0
    known = places.known_places(spark, [("Home", "Paris", ["hq"])])
    got = {r.n: (r.canonical, r.how) for r in places.normalise(spark.createDataFrame([("HQ",), ("home",), ("Londonn",), ("",), (None,)], "n string"), "n", known).collect()}
    assert got == {"HQ": ("Paris", "alias"), "home": ("Paris", "direct"), "Londonn": ("London", "fuzzy"), "": (None, None), None: (None, None)}
    assert "hq" in {r.variation for r in places.variations(known, "Paris").collect()} and places.place_stats(known).first().names == 30
    with pytest.raises(ValueError):
        geosearch.place_centre(known, "Nowhere at all")
    wide = geosearch.by_radius(points.where("lat is not null"), "id", "lat", "lng", (10.0, 10.0), 1, max_range=1e4)
    assert wide.count() == 41 and geosearch.by_radius(points, "id", "lat", "lng", (10.0, 10.0), 1).count() == 1


@pytest.mark.parametrize(("lat", "lng", "km"), [(0, 0, 500), (89.5, 10, 300), (-60, 179.9, 800), (45, -179.99, 50), (10, 10, 25_000)])
def test_box_keeps_the_circle(spark, lat, lng, km):
    grid = spark.range(181 * 91).select((F.col("id") % 91 * 2 - 90).cast("double").alias("a"), (F.floor(F.col("id") / 91) * 2 - 180).cast("double").alias("o"))
    near = grid.where(G.distance(F.col("a"), F.col("o"), lat, lng) <= km)
    assert near.where(~G.box_filter(F.col("a"), F.col("o"), lat, lng, km)).count() == 0


def test_statements_and_sources(spark, tmp_path):
    texts = ["select * from `a` where 1", "INSERT INTO b VALUES (1)", "update c set x=1", "delete from d", "create table if not exists e (x int)", "explain f"]
    rows = spark.createDataFrame([(t,) for t in texts], "sql string").select(statement_kind(F.col("sql")).alias("k"), statement_table(F.col("sql")).alias("t")).collect()
    assert [(r.k, r.t) for r in rows] == [("SELECT", "a"), ("INSERT", "b"), ("UPDATE", "c"), ("DELETE", "d"), ("CREATE", "e"), ("OTHER", None)]
    df = spark.createDataFrame([(1, '{"a": 1}', 1), (2, "plain", 2), (3, "[1,", None)], "id int, j string, flag int")
    for kind in ("parquet", "orc", "json", "csv"):
        write(df, str(tmp_path / kind), kind)
        assert read(spark, str(tmp_path / kind), kind, "id int, j string, flag int").count() == 3
    with pytest.raises(ValueError):
        read(spark, "x", "xls")
    cast = cast_read(df, ["flag"], ["j"]).select("flag", F.col("j_json").isNotNull().alias("read")).collect()
    assert [(r.flag, r.read) for r in cast] == [(True, True), (False, False), (None, False)]
    assert ddl("t", df.schema, ["id"]).startswith("CREATE TABLE t (") and "id?: number | null;" in interface("my_t", df.schema)


def test_singleton(spark):
    clear_engine()
    with pytest.raises(RuntimeError):
        get_engine()
    assert get_engine.__name__ and create_engine(spark) is get_engine()
    assert create_engine(spark, singleton=False) is not get_engine()
    clear_engine()

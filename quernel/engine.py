"""The engine: tables by name, lazily queried, with hooks, result cache and a query log."""

from __future__ import annotations

import hashlib
import json
import logging
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quernel.cache import Cache, cache_key
from quernel.catalog import Catalog, Settings, TableInfo, ddl, interface
from quernel.functions.geo import valid
from quernel.hooks import Hooks
from quernel.operators import cluster, geosearch, index, mutations, places, reads, relations, search
from quernel.plans.filter_model import compile_model, is_model, options_of, plain_filters, split_place
from quernel.plans.names import camel_columns, to_snake
from quernel.plans.predicates import Compiler
from quernel.session import cut, new_path
from quernel.sources.readers import cast_read, healthy

_log = logging.getLogger(__name__)


class Engine:
    """``engine.orders``, ``engine["orders"]``, ``engine("orders")`` and ``engine.table("orders")`` are the same table.

    Queries return DataFrames; ``first``-like calls (find_one, count) return
    values. Nothing runs before it must.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, settings: Settings | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.catalog, self.settings = spark, catalog or Catalog(), settings or Settings()
        self.hooks, self.cache, self.clock = Hooks(), Cache(self.catalog, self.settings, clock), clock
        self.held: dict[str, mutations.VersionedTable] = {}
        self.queries: list[dict] = []
        self._asked: dict[str, object] = {}
        self._warming: threading.Event | None = None
        self.indexes: dict[str, tuple[int, DataFrame]] = {}
        self.buckets: dict[str, tuple[int, DataFrame]] = {}
        self.geo_indexes: dict[str, tuple[int, DataFrame]] = {}

    def register(self, name: str, df: DataFrame, cast: bool = True) -> Table:
        """Make a frame a table; declared flag and JSON columns are cast."""
        info = self.catalog.info(name)
        self.held[name] = mutations.VersionedTable(name, cast_read(df, info.flag_columns, info.json_columns) if cast else df)
        self.held[name].df.createOrReplaceTempView(name)
        return self.table(name)

    def table(self, name: str) -> Table:
        if name not in self.held or name not in self.catalog.visible(self.held, self.settings):
            raise KeyError(f"no table {name}")
        return Table(self, name)

    __call__ = __getitem__ = table

    def __getattr__(self, name: str) -> Table:
        if name.startswith("_") or name not in self.__dict__.get("held", {}):
            raise AttributeError(name)
        return self.table(name)

    def tables(self) -> list[str]:
        return self.catalog.visible(sorted(self.held), self.settings)

    def schema(self, name: str) -> DataFrame:
        """column_name, data_type, nullable, is_key of a table."""
        df = self.held[name].df
        key = self.catalog.info(name).key
        rows = [(f.name, f.dataType.simpleString(), f.nullable, f.name in key) for f in df.schema.fields]
        return self.spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean, is_key boolean")

    def relationships(self) -> DataFrame:
        rows = [(e.table, e.column, e.parent, e.parent_column, e.on_delete, e.on_update) for e in self.catalog.edges]
        return self.spark.createDataFrame(rows, "from_table string, from_column string, to_table string, to_column string, on_delete string, on_update string")

    def table_sizes(self) -> DataFrame:
        """Rows of each table, in one plan."""
        parts = [self.held[n].df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n in self.tables()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def export(self, name: str, style: str = "ddl") -> str:
        schema = self.held[name].df.schema
        return ddl(name, schema, self.catalog.info(name).key) if style == "ddl" else interface(name, schema)

    def raw(self, sql: str, params: Sequence | None = None, cached: bool = False) -> DataFrame:
        """Any SQL over the registered tables, with ? parameters."""
        sql = self.hooks.run_before("*", "raw", sql)
        began = self.clock()
        run = lambda: self.spark.sql(sql, args=list(params or []))
        if cached:
            versions = sorted((n, t.version) for n, t in self.held.items())
            key = cache_key("*", "raw", [sql, list(params or []), versions])
            if (found := self.cache.get(key)) is None:
                found = self.cache.put(key, run(), self.held, self.settings.raw_ttl)
        else:
            found = run()
        self._track("*", "raw", {"sql": sql}, began, False)
        self.hooks.run_after("*", "raw", found)
        return found

    def health(self) -> dict[str, bool]:
        return {"session": healthy(self.spark)}

    def _track(self, table: str, operation: str, filters: object, began: float, hit: bool, error: str | None = None, correlation: str | None = None) -> None:
        text = json.dumps(filters, sort_keys=True, default=repr)
        query = hashlib.sha256(f"{table}:{operation}:{text}".encode()).hexdigest()[:32]
        self._asked[query] = filters
        self.queries.append({"id": len(self.queries) + 1, "query_id": query, "table_name": table, "query_type": operation, "filters": text, "execution_time_ms": float(self.clock() - began) * 1000, "cache_hit": hit, "logged_ms": int(time.time() * 1000), "error": error, "correlation_id": correlation})

    def log(self, correlation: str | None = None) -> DataFrame:
        """What was asked, with planning times and cache hits."""
        rows = [q for q in self.queries if correlation is None or q["correlation_id"] == correlation]
        return self.spark.createDataFrame([Row(**q) for q in rows], "id long, query_id string, table_name string, query_type string, filters string, execution_time_ms double, cache_hit boolean, logged_ms long, error string, correlation_id string")

    def clear_queries(self, correlation: str | None = None) -> None:
        self.queries = [q for q in self.queries if correlation is not None and q["correlation_id"] != correlation]
        held = {q["query_id"] for q in self.queries}
        self._asked = {k: v for k, v in self._asked.items() if k in held}

    def warm(self, limit: int = 10, at_least: int = 1) -> dict[str, object]:
        """Run the most asked findMany queries of each table again and keep them; the report has how many, and the hit rate before."""
        counts: dict[str, int] = {}
        table_of: dict[str, str] = {}
        for q in self.queries:
            if q["query_type"] == "findMany" and q["table_name"] in self.held:
                counts[q["query_id"]] = counts.get(q["query_id"], 0) + 1
                table_of[q["query_id"]] = q["table_name"]
        before, done = self.cache.stats()["hit_rate"], 0
        for name in self.tables():
            asked = sorted(((n, q) for q, n in counts.items() if table_of[q] == name and n >= at_least), key=lambda x: (-x[0], x[1]))[:limit]
            for _, query in asked:
                spec = self._asked[query]
                self.table(name).find_many(spec["where"], cache=True, ttl=self.settings.warm_ttl, **spec["options"]).count()
                done += 1
        return {"warmed": done, "hit_rate_before": before, "hit_rate_after": self.cache.stats()["hit_rate"]}

    def start_warming(self, every: float = 60.0, limit: int = 10, at_least: int = 1) -> None:
        """``warm`` every so many seconds on a thread of its own, in the scheduler pool 'warming', until ``stop_warming`` or ``close``; a failed run is logged and the next one comes."""
        self.stop_warming()
        stop = self._warming = threading.Event()

        def run() -> None:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", "warming")
            while not stop.wait(every):
                try:
                    self.warm(limit, at_least)
                except Exception:
                    _log.exception("warming failed")

        InheritableThread(target=run, daemon=True).start()

    def stop_warming(self) -> None:
        if self._warming is not None:
            self._warming.set()
            self._warming = None

    def build_all_indexes(self) -> dict[str, str]:
        """Index every table with declared search fields; what failed is told by table."""
        failed = {}
        for name in self.tables():
            if self.catalog.info(name).search_fields:
                try:
                    self.table(name).build_search_index()
                except Exception as wrong:
                    failed[name] = str(wrong)
        return failed

    def close(self) -> None:
        self.stop_warming()
        self.cache.clear()


class Table:
    """The operations on one table."""

    def __init__(self, engine: Engine, name: str) -> None:
        self.engine, self.name = engine, name

    @property
    def df(self) -> DataFrame:
        return self.engine.held[self.name].df

    @property
    def info(self) -> TableInfo:
        return self.engine.catalog.info(self.name)

    @property
    def key(self) -> tuple[str, ...]:
        return self.engine.catalog.key(self.name, self.df.columns)

    def compiler(self, table: str | None = None) -> Compiler:
        engine = self.engine
        rename = to_snake if engine.settings.case_conversion else (lambda n: n)
        return Compiler(engine.held[table or self.name].df.schema, engine.settings.ignore_case, rename)

    def _condition(self, where: Mapping | None) -> Column | None:
        return compile_model(self.compiler(), where) if is_model(where) else self.compiler().where(where)

    def filtered(self, where: Mapping | None) -> DataFrame:
        """Rows that meet a filter object or model, relation filters included."""
        if is_model(where):
            test = compile_model(self.compiler(), where)
            return self.df if test is None else self.df.where(test)
        plain, related = relations.split_relation_filters(where)
        test = self.compiler().where(plain)
        rows = self.df if test is None else self.df.where(test)
        compile_where = lambda table, w: self.compiler(table).where(w)
        return relations.filter_by_relations(rows, self.name, related, self.engine.catalog, self._other, compile_where) if related else rows

    def _other(self, name: str) -> DataFrame:
        return self.engine.held[name].df

    def _read(self, operation: str, where: Mapping | None, options: Mapping, make: Callable[[], DataFrame], cache: bool, ttl: float | None, correlation: str | None) -> DataFrame:
        engine, began = self.engine, self.engine.clock()
        params = {"where": where or {}, "options": {k: v for k, v in options.items() if v is not None}}
        key = cache_key(self.name, operation, params, engine.held[self.name].version)
        found = engine.cache.get(key) if cache else None
        hit = found is not None
        try:
            if not hit:
                found = make()
                if cache:
                    with_others = engine.cache.targets(self.name) if options.get("with_relations") or relations.split_relation_filters(where)[1] else [self.name]
                    found = engine.cache.put(key, found, with_others, ttl)
        except Exception as wrong:
            engine._track(self.name, operation, params, began, False, str(wrong), correlation)
            raise
        engine._track(self.name, operation, params, began, hit, None, correlation)
        return found

    def find_many(self, where: Mapping | None = None, select: Sequence[str] | None = None, order_by: object = None, limit: int | None = None, offset: int | None = None, with_relations: bool | Mapping | None = None, depth: int = 1, group_by: str | None = None, cache: bool = False, ttl: float | None = None, correlation_id: str | None = None) -> DataFrame:
        """Rows that meet ``where``, ordered, cut, projected, with relations attached.

        A limit is made the same on every run by the key as last sort column.
        With relations and no limit, the setting ``relation_limit`` cuts; a
        negative limit never does.
        """
        where = self.engine.hooks.run_before(self.name, "findMany", where)
        options = {"select": select, "order_by": order_by, "limit": limit, "offset": offset, "with_relations": with_relations, "group_by": group_by}
        options = options_of(where, options) if is_model(where) else {k: v for k, v in options.items() if v is not None}
        if options.get("with_relations") and not options.get("limit"):
            options["limit"] = self.engine.settings.relation_limit

        def make() -> DataFrame:
            rows = self.filtered(where)
            if options.get("group_by"):
                return reads.grouped(rows, options["group_by"])
            paging = (options.get("limit") or 0) > 0 or options.get("offset")
            order = reads.order_columns(rows, options.get("order_by"), self.key if paging else ())
            rows = reads.paged(rows, order, options.get("limit"), options.get("offset"))
            rows = relations.attach(rows, self.name, self.engine.catalog, self._other, options.get("with_relations") or False, depth)
            extra = [c for c in rows.columns if c not in self.df.columns]
            rows = reads.project(rows, [*options["select"], *extra] if options.get("select") else None)
            return camel_columns(rows) if self.engine.settings.case_conversion else rows

        return self._after("findMany", self._read("findMany", where, options, make, cache, ttl, correlation_id))

    def find_one(self, where: Mapping | None = None, **options: object) -> Row | None:
        where = self.engine.hooks.run_before(self.name, "findOne", where)
        return self._after("findOne", self.find_many(where, **{**options, "limit": 1}).first())

    def by_id(self, value: object) -> dict[str, object]:
        """The filter of one whole key: a value, or a tuple or mapping of all its columns; part of a key raises."""
        if isinstance(value, Mapping):
            if set(value) != set(self.key):
                raise ValueError(f"the key of {self.name} is {', '.join(self.key)}")
            return {c: value[c] for c in self.key}
        values = value if isinstance(value, tuple) else (value,)
        if len(values) != len(self.key):
            raise ValueError(f"the key of {self.name} is {', '.join(self.key)}")
        return dict(zip(self.key, values))

    def find_by_id(self, value: object, cache: bool = True) -> Row | None:
        """The row of one key, or None."""
        where = self.by_id(self.engine.hooks.run_before(self.name, "findById", value))
        return self._after("findById", self._read("findById", where, {}, lambda: self.filtered(where).limit(1), cache, None, None).first())

    def _after(self, operation: str, result: object) -> object:
        self.engine.hooks.run_after(self.name, operation, result)
        return result

    def count(self, where: Mapping | None = None, cache: bool = True) -> int:
        where = self.engine.hooks.run_before(self.name, "count", where)
        ttl = min(self.engine.settings.default_ttl, self.engine.settings.count_ttl)
        return self._after("count", self._read("count", where, {}, lambda: reads.counted(self.filtered(where)), cache, ttl, None).first().n)

    def page(self, where: Mapping | None = None, order_by: object = None, limit: int = 20, offset: int = 0) -> DataFrame:
        """A page with total and has_more."""
        rows = self.filtered(where)
        return reads.page_with_total(rows, reads.order_columns(rows, order_by, self.key), limit, offset)

    def _wrote(self, df: DataFrame) -> None:
        held = self.engine.held[self.name]
        held.become(df)
        held.df.createOrReplaceTempView(self.name)
        self.engine.cache.invalidate(self.name)

    def _insert(self, rows: Sequence[Mapping]) -> DataFrame:
        if not rows:
            return self.df.limit(0)
        after, new = mutations.insert(self.df, mutations.rows_frame(self.df, rows), self.key[0] if len(self.key) == 1 else None)
        self._wrote(after)
        return new

    def insert_many(self, rows: Sequence[Mapping]) -> DataFrame:
        """The rows with their keys (a key of several columns is never made up); columns are those of the first row. No rows: nothing happens."""
        return self._after("insertMany", self._insert(self.engine.hooks.run_before(self.name, "insertMany", rows)))

    def insert_one(self, row: Mapping) -> Row:
        return self._after("insertOne", self._insert([self.engine.hooks.run_before(self.name, "insertOne", row)]).first())

    def _test(self, where: Mapping | None, all_rows: bool) -> Column:
        test = self._condition(where)
        if test is None and not all_rows:
            raise ValueError("an empty filter would touch every row; pass all_rows=True")
        return F.lit(True) if test is None else test

    def _update(self, where: Mapping | None, patch: Mapping, all_rows: bool = False) -> int:
        test = self._test(where, all_rows)
        n = self.df.where(test).count()
        if n:
            self._wrote(mutations.update(self.df, test, patch))
        return n

    def update_many(self, where: Mapping | None, patch: Mapping, all_rows: bool = False) -> int:
        """How many rows got the patch."""
        patch = self.engine.hooks.run_before(self.name, "updateMany", patch)
        return self._after("updateMany", self._update(where, patch, all_rows))

    def update_one(self, where: Mapping | None, patch: Mapping, all_rows: bool = False) -> Mapping | None:
        """The patch if any row matched, else None. Like the other writes, it changes every row that matches."""
        patch = self.engine.hooks.run_before(self.name, "updateOne", patch)
        return self._after("updateOne", patch if self._update(where, patch, all_rows) else None)

    def update_by_id(self, value: object, patch: Mapping) -> Row | None:
        """The row of the whole key after the patch, or None; a patch may change the key."""
        patch = self.engine.hooks.run_before(self.name, "updateById", patch)
        where = self.by_id(value)
        found = self._update(where, patch)
        return self._after("updateById", self.df.where(self._test({**where, **{c: v for c, v in patch.items() if c in where}}, False)).first() if found else None)

    def _delete(self, where: Mapping | None, all_rows: bool = False) -> int:
        test = self._test(where, all_rows)
        n = self.df.where(test).count()
        if n:
            self._wrote(mutations.delete(self.df, test))
        return n

    def delete_many(self, where: Mapping | None, all_rows: bool = False) -> int:
        """How many rows went."""
        where = self.engine.hooks.run_before(self.name, "deleteMany", where)
        return self._after("deleteMany", self._delete(where, all_rows))

    def delete_one(self, where: Mapping | None, all_rows: bool = False) -> bool:
        """Whether any row went; deletes every row that matches."""
        where = self.engine.hooks.run_before(self.name, "deleteOne", where)
        return self._after("deleteOne", self._delete(where, all_rows) > 0)

    def delete_by_id(self, value: object) -> bool:
        """Whether the row of the whole key was there."""
        value = self.engine.hooks.run_before(self.name, "deleteById", value)
        return self._after("deleteById", self._delete(self.by_id(value)) > 0)

    def invalidate_cache(self) -> int:
        return self.engine.cache.invalidate(self.name)

    def warm_cache(self, where: Mapping | None = None, with_relations: bool | Mapping | None = None, depth: int = 1, limit: int = 100) -> int:
        """Keep a first page; how many rows it has."""
        return self.find_many(where, limit=limit, with_relations=with_relations if depth > 0 else None, depth=depth, cache=True, ttl=self.engine.settings.warm_ttl).count()

    def build_search_index(self, path: str | None = None, geo_buckets: bool = False) -> DataFrame:
        """Build, write and keep the index of the declared fields, with ``geo_buckets`` also the geo buckets; returns its figures."""
        fields = dict(self.info.search_fields)
        if not fields:
            raise ValueError(f"no search fields are declared for {self.name}")
        made = index.write(self.df, self.key[0], fields, self.info.tokenizer, path or new_path(self.engine.spark, f"index-{self.name}"), own=path is None)
        self.engine.indexes[self.name] = (self.engine.held[self.name].version, made)
        if geo_buckets:
            self.build_geo_buckets()
        return self.search_stats()

    def has_search_index(self) -> bool:
        """Whether an index of the table as it is is kept."""
        held = self.engine.indexes.get(self.name)
        return held is not None and held[0] == self.engine.held[self.name].version

    def clear_search_index(self) -> bool:
        """Forget the index; whether there was one."""
        return self.engine.indexes.pop(self.name, None) is not None

    rebuild_search_index = build_search_index

    def _index(self) -> index.Written:
        """The index, built anew if the table was written since."""
        if not self.has_search_index():
            self.build_search_index()
        return self.engine.indexes[self.name][1]

    def search_stats(self) -> DataFrame:
        """documents, terms and tokens of the index, counted when it was written."""
        return self._index().stats

    def documents_with(self, term: str, limit: int = 100) -> DataFrame:
        """Keys of rows that hold a term; a limit below 1 gives all."""
        return index.documents_of(self._index().postings, term, limit)

    def indexed_terms(self, limit: int = 1000) -> DataFrame:
        """Terms of the index in order; a limit below 1 gives all."""
        return index.all_terms(self._index().postings, limit)

    def search(self, query: str, fields: Sequence[str] | None = None, limit: int = 10, offset: int = 0, filters: Mapping | None = None, min_score: float = 0.0, highlight_fields: Sequence[str] | None = None, geo: Mapping | None = None, prefilter: bool = False, rank: str = "index", fuzzy: int = 0) -> DataFrame:
        """Rows that hold all terms of the query, scored; with ``geo``, rows near a place scored by text and distance.

        ``rank`` is 'index' (summed scores), 'bm25' or 'combined' (with the
        mean of the declared boosts); with ``fuzzy`` a term also stands for the
        terms at most that many edits away.
        """
        query = self.engine.hooks.run_before(self.name, "search", query)
        began, fields = self.engine.clock(), list(fields or dict(self.info.search_fields))
        if is_model(filters):
            filters, found = split_place(filters, self.info.lat, self.info.lng)
            geo = geo or found
        test = plain_filters(self.compiler(), filters)
        if geo:
            rows = self.search_geo(geo, limit=None) if test is None else geosearch.search_geo(self.df.where(test), self.key[0], self.info.lat, self.info.lng, geo, places.known_places(self.engine.spark), self._buckets())
            out = geosearch.text_and_geo(rows, self.key[0], fields, query, limit, min_score)
        else:
            out = search.search(self.df, self._index(), self.key[0], query, fields, limit, offset, test, min_score, list(highlight_fields or []), self.info.tokenizer, prefilter, rank, fuzzy, index.mean_boost(dict(self.info.search_fields)))
        out = camel_columns(out) if self.engine.settings.case_conversion else out
        self.engine._track(self.name, "search", {"query": query}, began, False)
        self.engine.hooks.run_after(self.name, "search", out)
        return out

    def search_geo(self, geo: Mapping, limit: int | None = None) -> DataFrame:
        if not (self.info.lat and self.info.lng):
            raise ValueError(f"no coordinates are declared for {self.name}")
        rows = self.df.where(valid(F.col(self.info.lat), F.col(self.info.lng)))
        return geosearch.search_geo(rows, self.key[0], self.info.lat, self.info.lng, geo, places.known_places(self.engine.spark), self._buckets(), limit)

    def _buckets(self) -> DataFrame | None:
        """The buckets built from the table as it is now."""
        held = self.engine.buckets.get(self.name)
        return held[1] if held and held[0] == self.engine.held[self.name].version else None

    def build_geo_index(self, buckets: DataFrame | None = None) -> DataFrame:
        """Rows with a valid location, their first bucket and canonical place; written once and kept until the table is written."""
        if not (self.info.lat and self.info.lng):
            raise ValueError(f"no coordinates are declared for {self.name}")
        known = places.known_places(self.engine.spark)
        found = cut(geosearch.geo_index(self.df, self.key[0], self.info.lat, self.info.lng, self._buckets() if buckets is None else buckets, self.info.place, known))
        self.engine.geo_indexes[self.name] = (self.engine.held[self.name].version, found)
        return found

    def geo_index(self) -> DataFrame:
        """The kept geo index, built anew if the table was written since."""
        held = self.engine.geo_indexes.get(self.name)
        return held[1] if held and held[0] == self.engine.held[self.name].version else self.build_geo_index()

    def geo_stats(self) -> DataFrame:
        """One row: documents of the geo index, how many have a bucket, buckets that hold any, and the world's bounds."""
        return geosearch.geo_totals(self.geo_index())

    def clear_geo_index(self) -> bool:
        """Forget the geo index and the buckets; whether there were any."""
        held = [self.engine.geo_indexes.pop(self.name, None), self.engine.buckets.pop(self.name, None)]
        return any(h is not None for h in held)

    def build_geo_buckets(self, target: int = 5, grid_km: float = 10.0, smallest: int = 3) -> DataFrame:
        """Buckets of the table's points in a list order, written once and kept until the table is written."""
        found = cut(cluster.numbered(cluster.buckets(self.df, self.key[0], self.info.lat, self.info.lng, self.info.place, target, grid_km, smallest)))
        self.engine.buckets[self.name] = (self.engine.held[self.name].version, found)
        return found

    def geo_buckets(self) -> DataFrame:
        if (found := self._buckets()) is None:
            raise ValueError(f"no buckets were built for {self.name} as it is")
        return found


_single: Engine | None = None


def create_engine(spark: SparkSession, catalog: Catalog | None = None, settings: Settings | None = None, singleton: bool = True) -> Engine:
    """An engine; with ``singleton`` the one that ``get_engine`` returns."""
    global _single
    engine = Engine(spark, catalog, settings)
    if singleton:
        _single = engine
    return engine


def get_engine() -> Engine:
    if _single is None:
        raise RuntimeError("no engine was created")
    return _single


def clear_engine() -> None:
    global _single
    if _single is not None:
        _single.close()
    _single = None


def correlation_id() -> str:
    """A new id to follow one request's queries by."""
    return str(uuid.uuid4())

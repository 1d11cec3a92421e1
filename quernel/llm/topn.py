"""The best items of every group, reading only row groups that can hold one.

Items are clustered once: files sorted by group and falling score, cut into row
groups, with a directory of which groups each row group holds, how many items
of each, and their highest, n-th and lowest score there. The directory bounds
each group's n-th score from below before any item is read; a row group whose
items are strictly below the bounds of all the groups it holds, be it one or
thousands, is never read. What is left is read by falling highest score, under
the same rule with the n-th scores found so far. Further items are clustered
as further runs beside the first; bounds hold across runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import cut, forget_at_end, new_path, reader_partitions, ship

#: Rows of a file's first row groups; every STAGE row groups they double, up to MOST, so files of any size have few.
ROWS, STAGE, MOST = 512, 32, 1 << 17
#: Row groups read by one task at a time.
UNIT = 64


def latest(df: DataFrame, key: str, when: str) -> DataFrame:
    """Of each key the row with the latest ``when`` (null is earliest; ties: the greatest row), one combined aggregate."""
    rest = [c for c in df.columns if c not in (key, when)]
    best = df.groupBy(key).agg(F.max(F.struct(when, *rest)).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col(f"_best.{c}") for c in df.columns])


def _runs(items: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The groups of sorted items, and where each starts and ends."""
    column = items.column("_group").combine_chunks()
    encoded = pc.run_end_encode(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
    ends = encoded.run_ends.to_numpy(zero_copy_only=False).astype(np.int64)
    return encoded.values, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _scores(items: pa.Table) -> np.ndarray:
    return pc.cast(items.column("_score"), pa.float64()).to_numpy()


def _writer(folder: str, depth: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a sorted partition as one file and tells its directory; a task tried again writes another file, and only the directory of the one that ended counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        name = f"{folder}/{uuid.uuid4().hex}.parquet"
        where, path = fs.FileSystem.from_uri(name)
        held: list[pa.RecordBatch] = []
        size = k = 0
        sink = out = None
        limit = lambda: min(MOST, rows << min(k // STAGE, 40))

        def tell(items: pa.Table) -> pa.RecordBatch:
            groups, starts, ends = _runs(items)
            scores = _scores(items)
            columns = [pa.array([name] * len(groups)), pa.array(np.full(len(groups), k), pa.int32()), groups, pa.array(ends - starts, pa.int64()), *(pa.array(scores[at]) for at in (starts, np.minimum(starts + depth, ends) - 1, ends - 1))]
            return pa.RecordBatch.from_arrays(columns, ["file", "row_group", "group", "n", "high", "nth", "low"])

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    where.create_dir(path.rsplit("/", 1)[0])
                    sink = where.open_output_stream(path)
                    out = pq.ParquetWriter(sink, batch.schema, compression="zstd")
                held.append(batch)
                size += batch.num_rows
                while size >= limit():
                    items, most = pa.Table.from_batches(held), limit()
                    out.write_table(items.slice(0, most), row_group_size=most)
                    yield tell(items.slice(0, most))
                    k += 1
                    held, size = items.slice(most).to_batches(), size - most
            if size:
                items = pa.Table.from_batches(held)
                out.write_table(items, row_group_size=size)
                yield tell(items)
        finally:
            if out is not None:
                out.close()
                sink.close()

    return run


def _best_of_units(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first n items of each group in each row group that is read; a row group is passed over when all its groups have n items above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for uri, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, path = fs.FileSystem.from_uri(uri)
                nth: dict[object, float] = {}
                with where.open_input_file(path) as opened:
                    source = pq.ParquetFile(opened)
                    for part in sorted(parts, key=lambda p: (-p["high"], p["row_group"])):
                        if all(g["high"] < nth.get(g["group"], -np.inf) for g in part["groups"]):
                            continue
                        items = source.read_row_group(part["row_group"])
                        groups, starts, ends = _runs(items)
                        scores, full = _scores(items), np.flatnonzero(ends - starts >= n)
                        for g, s in zip(groups.take(pa.array(full)).to_pylist(), scores[starts[full] + n - 1]):
                            nth[g] = max(s, nth.get(g, -np.inf))
                        place = np.arange(len(items)) - np.repeat(starts, ends - starts)
                        yield from items.filter(pa.array(place < n)).combine_chunks().to_batches()

    return run


@dataclass
class Clustered:
    """Clustered runs of items: the directory (file, row_group, group, n, high, nth, low), and what top_n and more runs need."""

    directory: DataFrame
    names: dict[str, str]
    order: list[tuple[str, bool]]
    items: DataFrame
    depth: int

    def _sorting(self) -> list[Column]:
        return [F.desc("_score"), *[F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in self.order]]

    def add(self, df: DataFrame, rows: int = ROWS) -> Clustered:
        """The same with the items of ``df`` as a further run; neither run is written anew."""
        further = cluster(df, self.names["_group"], self.names["_score"], [(self.names[c], up) for c, up in self.order], self.depth, rows)
        return Clustered(self.directory.unionByName(further.directory), self.names, self.order, self.items, self.depth)

    def _bounds(self, n: int) -> DataFrame:
        bound = F.when(F.col("n") >= n, F.col("nth") if n <= self.depth else F.col("low"))
        return self.directory.groupBy("group").agg(F.max(bound).alias("bound")).where(F.col("bound").isNotNull())

    def kept(self, n: int) -> DataFrame:
        """The directory rows of the row groups that must be read for the best ``n``."""
        held = self.directory.join(self._bounds(n), "group", "left")
        needed = held.where(F.col("bound").isNull() | (F.col("high") >= F.col("bound"))).select("file", "row_group").distinct()
        return self.directory.join(needed, ["file", "row_group"], "left_semi")

    def top_n(self, n: int) -> DataFrame:
        """Up to ``n`` rows of each group with ``rank``; see ``top_n``."""
        spark = self.items.sparkSession
        per_row_group = self.kept(n).groupBy("file", "row_group").agg(F.max("high").alias("high"), F.collect_list(F.struct("group", "high")).alias("groups"))
        units = per_row_group.groupBy("file", F.floor(F.col("row_group") / UNIT).alias("unit")).agg(F.collect_list(F.struct("row_group", "high", "groups")).alias("parts"))
        spread = units.select("file", "parts").repartition(4 * reader_partitions(spark), "file", "parts")
        best = spread.mapInArrow(_best_of_units(n), self.items.schema)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("_group").orderBy(*self._sorting())))
        return ranked.where(F.col("rank") <= n).withColumnsRenamed(self.names)


def cluster(df: DataFrame, group: str, score: str, ties: list[tuple[str, bool]], depth: int, rows: int = ROWS) -> Clustered:
    """Items written clustered in the shared folder, for any number of ``top_n`` calls; those of up to ``depth`` have the sharpest bounds.

    Range partitioning by group and score spreads a group of any size over files.
    """
    spark = df.sparkSession
    ship(spark)
    names = {"_group": group, "_score": score} | {f"_k{i}": c for i, (c, _) in enumerate(ties)}
    items = df.select(*[F.col(c).alias(a) for a, c in names.items()]).where(F.col("_group").isNotNull() & F.col("_score").isNotNull())
    if dict(items.dtypes)["_score"] in ("double", "float"):
        items = items.where(~F.isnan("_score"))
    found = Clustered(items, names, [(f"_k{i}", up) for i, (_, up) in enumerate(ties)], items.limit(0), depth)
    by = [F.asc("_group"), *found._sorting()]
    folder = new_path(spark, "clustered")
    forget_at_end(spark, folder)
    ordered = items.repartitionByRange(reader_partitions(spark), *by).sortWithinPartitions(*by)
    kind = items.schema["_group"].dataType.simpleString()
    found.directory = cut(ordered.mapInArrow(_writer(folder, depth, rows), f"file string, row_group int, group {kind}, n long, high double, nth double, low double"))
    return found


def top_n(df: DataFrame, group: str, score: str, ties: list[tuple[str, bool]], n: int, rows: int = ROWS) -> DataFrame:
    """Up to ``n`` rows of each group: highest ``score`` first, then by ``ties`` (column, rising).

    Columns: group, score, the tie columns, rank. Rows with a null group, or a
    null or NaN score, don't compete. Nulls in tie columns come last. Rows
    equal in all of these are kept as they are, so remove repeats before; which
    of fully equal rows is taken makes no difference. Groups with fewer rows
    come out whole; an empty input gives no rows. Other columns are ignored.
    """
    return cluster(df, group, score, ties, n, rows).top_n(n)

"""Frequencies of all terms and term sequences of a corpus, by suffix sorting.

Every position of a text gives the suffix that starts there, cut to ``sigma``
terms. Suffixes are routed by their first term (and by a slice of the records,
so that a term in a third of all records is the work of many tasks), sorted in
reverse lexicographic order and read once with a stack: the stack holds the
prefixes of the current suffix with their counts and record sets, and whatever
the next suffix no longer shares is complete, is emitted and adds to its parent.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernel.session import cut, reader_partitions, ship

#: Terms of a suffix.
SIGMA = 3
#: Records whose sets one stack may have to hold.
SLICE = 100_000


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def terms_of(text: Column) -> Column:
    """The longest runs of letters and digits, lower case, composed (NFC), in text order.

    Only texts with other than ASCII characters go to Python, for composing.
    """
    folded = F.lower(F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


class _Stack:
    """Counts and record sets (arrays of record numbers) of the prefixes of the current suffix."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.frames: list[list] = []
        self.place: tuple[str, int] | None = None
        self.out: list[tuple[str, str, int, int]] = []

    def add(self, place: tuple[str, int], suffix: str, count: int, records: np.ndarray) -> None:
        terms = suffix.split(" ")
        shared = 0
        if place == self.place:
            most = min(len(terms), len(self.frames))
            while shared < most and self.frames[shared][0] == terms[shared]:
                shared += 1
        self.pop(shared)
        self.place = place
        self.frames.extend([t, 0, []] for t in terms[shared:])
        self.frames[-1][1] += count
        self.frames[-1][2].append(records)

    def pop(self, depth: int) -> None:
        while len(self.frames) > depth:
            term, count, sets = self.frames.pop()
            records = sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
            if len(self.frames) < self.longest:
                self.out.append((self.place[0], " ".join([f[0] for f in self.frames] + [term]), count, len(records)))
            if self.frames:
                self.frames[-1][1] += count
                self.frames[-1][2].append(records)


def _counter(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffixes sorted by field, slice and descending text become counted prefixes of up to ``longest`` terms."""
    kinds = {"field": pa.string(), "ngram": pa.string(), "occurrences": pa.int64(), "records": pa.int64()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack(longest)

        def ready() -> pa.RecordBatch:
            columns = list(zip(*stack.out)) or [[]] * 4
            stack.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]).to_numpy(zero_copy_only=False) for k in range(3)])
            numbers = batch.column(3).to_numpy()
            starts = np.flatnonzero(new)
            other = new.copy()
            other[1:] |= numbers[1:] != numbers[:-1]
            sets, ends = numbers[other], np.cumsum(other)[np.append(starts[1:], batch.num_rows) - 1].tolist()
            sizes = np.diff(np.append(starts, batch.num_rows)).tolist()
            field, piece, suffix = (batch.column(k).take(pa.array(starts)).to_pylist() for k in range(3))
            for f, k, s, c, a, b in zip(field, piece, suffix, sizes, [0, *ends[:-1]], ends):
                stack.add((f, k), s, c if s else 0, sets[a:b])
            if len(stack.out) > 50_000:
                yield ready()
        stack.pop(0)
        yield ready()

    return count


def ngram_frequencies(df: DataFrame, record: str, fields: dict[str, str], sigma: int = SIGMA, longest: int | None = None, slice_records: int = SLICE) -> DataFrame:
    """Every sequence of 1 to ``longest`` (default: ``sigma``) terms with its occurrences and records.

    ``fields`` maps a label to a text column. Columns: field, ngram (terms
    joined by a blank), occurrences, records. A record is a value of the column
    ``record`` (null is one too); equal texts of a record in a field count
    once, different ones all count, in one record. Null texts are no records
    of the field; empty ones are, without terms. The empty ngram has the
    records of the field, and no occurrences. Sequences never cross texts.
    Nothing is cut: texts are read whole and all sequences come out.

    The table is read once (its rows are counted from its metadata to size the
    slices); each suffix goes once to where its first term and its slice of
    records are sorted, and only counts leave there.
    """
    spark = df.sparkSession
    ship(spark)
    slices = max(1, -(-df.count() // slice_records))
    texts = df.select(F.col(record).alias("_record"), F.inline(F.array(*[F.struct(F.lit(label).alias("field"), F.col(c).alias("_text")) for label, c in fields.items()])))
    texts = texts.where(F.col("_text").isNotNull()).distinct()
    number = F.xxhash64("_record") if dict(df.dtypes)[record] not in ("bigint", "int", "smallint", "tinyint") else F.coalesce(F.col("_record").cast("long"), F.lit(-(1 << 63)))
    slice_ = F.pmod(F.xxhash64("_record"), F.lit(slices)).cast("int")
    rows = texts.select("field", number.alias("number"), slice_.alias("slice"), terms_of(F.col("_text")).alias("terms"))
    suffixes = F.transform("terms", lambda t, i: F.array_join(F.slice("terms", i + 1, sigma), " "))
    # never empty, and outer so that no filter on it is inferred, which would compose and cut the texts twice
    rows = rows.select("field", "slice", "number", F.explode_outer(F.concat(F.array(F.lit("")), suffixes)).alias("suffix"))
    routed = rows.repartition(reader_partitions(spark), F.col("field"), F.substring_index("suffix", " ", 1), F.col("slice")).sortWithinPartitions("field", "slice", F.desc("suffix"), "number")
    parts = routed.select("field", "slice", "suffix", "number").mapInArrow(_counter(longest or sigma), "field string, ngram string, occurrences bigint, records bigint")
    return parts.groupBy("field", "ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_marks(df: DataFrame, record: str, fields: dict[str, str], rare_below: int = 3, common_share: float = 0.3) -> DataFrame:
    """``ngram_frequencies`` of single terms with ``mark``.

    The mark is 'rare' below ``rare_below`` records, else 'common' from
    ``common_share`` of the field's records on, else null. The frequencies are
    written once (a row a term); the fields' record counts, which are those of
    the empty ngram, are read from there and put into the plan.
    """
    found = cut(ngram_frequencies(df, record, fields, longest=1))
    sizes = dict(found.where(F.col("ngram") == "").select("field", "records").collect())
    size = F.lit(None).cast("long")
    for label, n in sizes.items():
        size = F.when(F.col("field") == label, F.lit(n)).otherwise(size)
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") >= size * common_share, "common")
    return found.where(F.col("ngram") != "").select("field", F.col("ngram").alias("term"), "occurrences", "records", mark.alias("mark"))

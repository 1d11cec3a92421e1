"""The inverted index as a table (term, doc_id, tf, score, ...), and ranking on it.

Written once, sorted by term, with each document's length beside its postings
and the corpus totals kept aside, a lookup reads only the row groups that hold
the query's terms, whatever the ranking; nothing is tokenised again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import score as S
from quernel.functions.text import merged_positions, tokens_of
from quernel.session import forget_at_end


def build_index(df: DataFrame, key: str, fields: Mapping[str, float], kind: str = "simple") -> DataFrame:
    """doc_id, term, tf, score, positions, length and entries per term of each row with a key.

    tf counts the term in all fields; score is tf times the boost of the first
    field that holds it (0 or None: 1). positions are those of the first field;
    length is the sum of the document's tf; entries are the fields that hold
    the term. Rows without a key are left out; repeated rows add up. Documents
    are shuffled once, whole.
    """
    names = [f for f in fields if dict(df.dtypes).get(f) == "string"]
    boosts = F.array(*[F.lit(float(fields[f] or 1.0)) for f in names])
    merged = merged_positions(df.where(F.col(key).isNotNull()), [key], names, kind)
    rows = merged.groupBy(F.col(key).alias("doc_id"), "term").agg(F.sum(F.size("positions")).alias("tf"), F.min(F.struct("field_ord", "positions")).alias("_f"), F.count(F.lit(1)).alias("entries"))
    rows = rows.select("doc_id", "term", "tf", (F.col("tf") * F.element_at(boosts, F.col("_f.field_ord") + 1)).alias("score"), F.col("_f.positions").alias("positions"), "entries")
    return rows.withColumn("length", F.sum("tf").over(Window.partitionBy("doc_id")))


@dataclass(frozen=True)
class Written:
    """postings as ``build_index`` gives them, one row of figures (documents, terms, tokens), documents with terms and their mean length."""

    postings: DataFrame
    stats: DataFrame
    total: int
    mean_length: float

    def within(self, ids: DataFrame) -> Written:
        """The same corpus, looked up among some documents only."""
        return replace(self, postings=self.postings.join(ids.select("doc_id"), "doc_id", "left_semi"))


def write(df: DataFrame, key: str, fields: Mapping[str, float], kind: str, path: str, own: bool = True) -> Written:
    """Build the index and write it to ``path``; an ``own`` one goes with the session. The totals are one aggregate of what was written."""
    write_index(build_index(df, key, fields, kind), path)
    if own:
        forget_at_end(df.sparkSession, path)
    return opened(df, path)


def opened(df: DataFrame, path: str) -> Written:
    """A written index of ``df``."""
    spark = df.sparkSession
    postings = spark.read.parquet(path)
    per_term = postings.groupBy("term").agg(F.sum("entries").alias("entries"), F.sum("tf").alias("tf"))
    terms = per_term.agg(F.count(F.lit(1)), F.coalesce(F.sum("entries"), F.lit(0)), F.coalesce(F.sum("tf"), F.lit(0))).first()
    total = postings.select("doc_id").distinct().count()
    stats = spark.createDataFrame([(df.count(), terms[0], terms[1])], "documents long, terms long, tokens long")
    return Written(postings, stats, total, terms[2] / total if total else 0.0)


def write_index(index: DataFrame, path: str) -> None:
    """The index as Parquet, range-partitioned and sorted by term (hot terms spread over files by document)."""
    index.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def update_documents(index: DataFrame, changed: DataFrame, key: str, fields: Mapping[str, float], kind: str = "simple") -> DataFrame:
    """The index with the rows of ``changed`` indexed anew."""
    return delete_documents(index, changed.select(F.col(key).alias("doc_id"))).unionByName(build_index(changed, key, fields, kind))


def delete_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def query_terms(df: DataFrame, query: str, kind: str = "simple") -> list[str]:
    """The query through the same tokeniser, each term once."""
    spark = df.sparkSession
    row = spark.range(1).select(F.array_distinct(F.transform(tokens_of(F.lit(query), kind), lambda t: t["term"])).alias("t")).first()
    return list(row.t)


def search_index(index: DataFrame, terms: list[str], limit: int | None = 10) -> DataFrame:
    """doc_id and score of the documents that hold all terms: the sum of their scores, highest first, ties by id as text, falling.

    No terms: no rows. Aggregates before it cuts, so one pass and one small
    shuffle of the matching postings.
    """
    hits = index.where(F.col("term").isin(terms) if terms else F.lit(False))
    found = hits.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(terms)).drop("_n")
    order = [F.desc("score"), F.desc(F.col("doc_id").cast("string"))]
    return found.orderBy(*order).limit(limit) if limit else found.orderBy(*order)


def documents_of(index: DataFrame, term: str, limit: int = 100) -> DataFrame:
    """Documents that hold a term, by id; a limit below 1 gives all."""
    found = index.where(F.col("term") == term).select("doc_id").orderBy("doc_id")
    return found.limit(limit) if limit > 0 else found


def all_terms(index: DataFrame, limit: int = 1000) -> DataFrame:
    """The terms in order; a limit below 1 gives all."""
    found = index.select("term").distinct().orderBy("term")
    return found.limit(limit) if limit > 0 else found


def alternatives(index: Written, terms: list[str], distance: int) -> Written:
    """The corpus as if each term stood for all terms at most ``distance`` edits away: postings of one document add up, its score is theirs."""
    near = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.levenshtein(F.col("near"), t) <= distance) if terms else F.array().cast("array<string>")
    vocabulary = index.postings.select(F.col("term").alias("near")).distinct()
    meant = vocabulary.select("near", F.explode(near).alias("_t"))
    rows = index.postings.join(meant, F.col("term") == F.col("near")).groupBy("doc_id", F.col("_t").alias("term"))
    return replace(index, postings=rows.agg(F.sum("tf").alias("tf"), F.sum("score").alias("score"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), F.sum("entries").alias("entries"), F.first("length").alias("length")))


def mean_boost(fields: Mapping[str, float]) -> float:
    """The mean of the declared boosts (0 or None: 1), 1 without any."""
    return sum(float(b or 1.0) for b in fields.values()) / len(fields) if fields else 1.0


def _scored(index: Written, terms: list[str], value: Column) -> DataFrame:
    hits = index.postings.where(F.col("term").isin(terms) if terms else F.lit(False))
    frequency = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(frequency), "term").withColumn("total", F.lit(index.total)).withColumn("mean_length", F.lit(index.mean_length))
    return rows.withColumn("value", value)


def tf_idf_scores(index: Written, terms: list[str]) -> DataFrame:
    """doc_id, term, value. The joined frequencies are one row per query term."""
    return _scored(index, terms, S.tf_idf(F.col("tf"), F.col("df"), F.col("total"))).select("doc_id", "term", "value")


def bm25_scores(index: Written, terms: list[str]) -> DataFrame:
    """doc_id and the sum of BM25 over the terms it holds."""
    value = S.bm25(F.col("tf"), F.col("df"), F.col("total"), F.col("length"), F.col("mean_length"))
    return _scored(index, terms, value).groupBy("doc_id").agg(F.sum("value").alias("score"))


def proximity_scores(index: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id and how close the terms stand, in the query's order of terms."""
    order = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term")) if terms else F.lit(0)
    hits = index.where(F.col("term").isin(terms) if terms else F.lit(False)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "positions"))).alias("_p"))
    return hits.select("doc_id", S.proximity(F.transform("_p", lambda p: p["positions"]), len(terms)).alias("score"))


def ranked(index: Written, terms: list[str], boost: float = 1.0) -> DataFrame:
    """doc_id and the mean over its terms of the combined score, highest first."""
    near = proximity_scores(index.postings, terms).withColumnRenamed("score", "near")
    rows = tf_idf_scores(index, terms).join(near, "doc_id")
    total = rows.groupBy("doc_id").agg(F.avg(S.combined(F.col("value"), F.lit(boost), F.col("near"))).alias("score"))
    return total.orderBy(F.desc("score"), F.desc(F.col("doc_id").cast("string")))

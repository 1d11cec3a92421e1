"""Full-text search over a table and its index; suggestions, facets and bands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import score as S
from quernel.operators.index import Written, alternatives, bm25_scores, query_terms, ranked, search_index


#: Ids of a page up to which it is broadcast; larger pages are joined by a shuffle.
PAGE = 10_000


def search(df: DataFrame, index: Written, key: str, query: str, fields: list[str], limit: int = 10, offset: int = 0, filters: Column | None = None, min_score: float = 0.0, highlights: list[str] | None = None, kind: str = "simple", prefilter: bool = False, rank: str = "index", fuzzy: int = 0, boost: float = 1.0) -> DataFrame:
    """Rows that hold all terms, in the index's order, with score, matched_terms and highlights.

    As in the engine's default, the page is taken from the index before filters
    and ``min_score`` apply, so pages may be short; ``prefilter`` filters first.
    ``rank`` 'bm25' or 'combined' (with ``boost``) orders by that instead of
    the summed scores; with ``fuzzy`` a term stands for those at most so many
    edits away. The page of ids is joined to the table after it is cut.
    """
    if rank not in ("index", "bm25", "combined"):
        raise ValueError(f"no ranking {rank}")
    terms = query_terms(df, query, kind)
    if prefilter and filters is not None:
        index = index.within(df.where(filters).select(F.col(key).alias("doc_id")))
    if fuzzy:
        index = alternatives(index, terms, fuzzy)
    found = search_index(index.postings, terms, None)
    if rank != "index":
        scored = bm25_scores(index, terms) if rank == "bm25" else ranked(index, terms, boost)
        found = found.select("doc_id").join(scored, "doc_id").orderBy(F.desc("score"), F.desc(F.col("doc_id").cast("string")))
    found = found.limit(limit + offset)
    page = (found.offset(offset) if offset else found).select(F.col("doc_id").alias("_id"), F.col("score").alias("_rank"))
    page = F.broadcast(page) if limit + offset <= PAGE else page
    rows = df.alias("d").join(page.alias("p"), F.col(f"d.{key}") == F.col("p._id"))
    if filters is not None:
        rows = rows.where(filters)
    words = S.query_terms(query)
    rows = rows.withColumn("score", F.round(S.simple_score([F.col(f"d.{f}") for f in fields], query), 6)).where(F.col("score") >= min_score)
    marked = F.create_map(*[x for f in highlights or [] for x in (F.lit(f), S.highlight(F.col(f"d.{f}"), words))]) if highlights else F.create_map().cast("map<string,string>")
    return rows.orderBy(F.desc("_rank"), F.desc(F.col("_id").cast("string"))).select("d.*", "score", F.array(*[F.lit(w) for w in words]).cast("array<string>").alias("matched_terms"), marked.alias("highlights"))


def suggestions(df: DataFrame, column: str, prefix: str, limit: int = 10) -> DataFrame:
    """Values that start with the prefix in any case, most frequent first."""
    hits = df.where(F.lower(F.col(column)).startswith(prefix.lower()))
    return hits.groupBy(F.col(column).alias("suggestion")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "suggestion").limit(limit)


def fuzzy_terms(index: DataFrame, term: str, distance: int = 1) -> DataFrame:
    """Terms of the index at most ``distance`` edits from the term, nearest first."""
    d = F.levenshtein(F.col("term"), F.lit(term), distance)
    return index.select("term").distinct().withColumn("edits", d).where(F.col("edits") >= 0).orderBy("edits", "term")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value and n of every value of several columns, in one pass (grouping sets)."""
    names = [f"`{c}`" for c in columns]
    sets = df.select(*[F.col(n).cast("string").alias(f"_f{i}") for i, n in enumerate(names)])
    rows = sets.select(F.inline(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(f"_f{i}").alias("value")) for i, c in enumerate(columns)])))
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def range_facets(df: DataFrame, column: str, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """How many rows lie in each named range [low, high); the first that fits counts."""
    band = F.lit(None).cast("string")
    for name, (low, high) in reversed(list(ranges.items())):
        test = (F.col(column) >= low if low is not None else F.lit(True)) & (F.col(column) < high if high is not None else F.lit(True))
        band = F.when(test, name).otherwise(band)
    return df.select(band.alias("band")).where(F.col("band").isNotNull()).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def score_bands(df: DataFrame, score: str = "score") -> DataFrame:
    """Results in the bands 80-100, 50-79 and 0-49 per cent; the upper bound of a band is the next one's lower."""
    return range_facets(df.withColumn("_s", F.col(score) * 100), "_s", {"80-100": (80, None), "50-79": (50, 80), "0-49": (None, 50)})

"""Queries of the problems tagged llm, with SQL for DuckDB where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.collapse import collapse
from quernel.llm.mix import mixture
from quernel.llm.percentiles import merge, percentiles, sketches
from quernel.llm.readlevel import ADVANCED, reading_level, train_on
from quernel.llm.terms import ngram_frequencies, term_marks
from quernel.llm.tokens import encode_corpus
from quernel.llm.topn import latest, top_n
from quernel.session import table


def _terms(spark: SparkSession, d: str) -> DataFrame:
    services = term_marks(table(spark, d, "services"), "id", {"services.description": "description"})
    products = term_marks(table(spark, d, "products"), "id", {"products.name": "name", "products.description": "description"})
    return services.unionByName(products)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to help a search."""
    return _terms(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences and records."""
    return _terms(spark, d).select("field", "term", "occurrences", "records")


def p1_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence of one to three terms of the three fields."""
    services = ngram_frequencies(table(spark, d, "services"), "id", {"services.description": "description"})
    products = ngram_frequencies(table(spark, d, "products"), "id", {"products.name": "name", "products.description": "description"})
    return services.unionByName(products).where(F.col("ngram") != "")


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "query_log").where(F.col("table_name").isNotNull() & (F.col("execution_time_ms") >= 0))
    rows = log.select("id", "table_name", "query_type", "execution_time_ms", F.floor(F.col("logged_ms") / 86_400_000).alias("day")).distinct()
    return sketches(rows, ["table_name", "query_type", "day"], "execution_time_ms")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of at least 50 rows whose 90th percentile is at least 8 times the median."""
    keys = ["table_name", "query_type"]
    merged = merge(_day_sketches(spark, d), keys).where(F.col("n") >= 50)
    wide = percentiles(merged, keys, [0.5, 0.9]).groupBy(*keys).agg(F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("mid"), F.max(F.when(F.col("prob") == 0.9, F.col("value"))).alias("high"))
    return wide.where(F.col("high") >= 8 * F.col("mid")).select(*keys)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentile per table and type with the values at the ends of their error."""
    keys = ["table_name", "query_type"]
    return percentiles(merge(_day_sketches(spark, d), keys), keys, [0.5, 0.9, 0.95, 0.99])


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return collapse(table(spark, d, "query_records"), "record_id", ["table_name", "query_type"], "query_id", "filters")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies that differ in writing only, with the record that is kept."""
    members = _records(spark, d)[1]
    return members.where(F.col("record_id") != F.col("kept_id")).select("kept_id", "record_id")


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    """One record of each set with the number of copies."""
    return _records(spark, d)[0].select("kept_id", "copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The five queries of each table with the most accesses."""
    stats = table(spark, d, "query_stats").select("query_id", "table_name", "access_count", "last_accessed_at")
    best = top_n(latest(stats, "query_id", "last_accessed_at"), "table_name", "access_count", [("last_accessed_at", False), ("query_id", True)], 5)
    return best.select("table_name", "query_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "ids")


def _mixture(spark: SparkSession, d: str):
    return mixture(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_weights"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources too small for their share even at their cap."""
    return _mixture(spark, d).shares.where("capped").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of every source."""
    return _mixture(spark, d).shares


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The rate and copies of every document in the mixture, and how surely it belongs to its likeliest source."""
    return _mixture(spark, d).records.select("doc_id", "source", "n_tokens", F.array_max("posterior").alias("surest"), "rate", "copies")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("lang") == "en")
    model = train_on(table(spark, d, "reading_samples"), "sample_id", "text", "level", styled=docs.select("doc_id", "text", "source"))
    return reading_level(docs, "doc_id", "text", model)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """English documents whose prose needs 13 or more years of school."""
    return _levels(spark, d).where(F.col("grade") >= ADVANCED).select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """The grade of every English document."""
    return _levels(spark, d)


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p1_ngrams, p2_found, p2_percentiles, p4_found, p4_kept, p5_found, p7_ids, p8_found, p8_shares, p8_mixture, p9_found, p9_levels)}

_TEXTS = """
        WITH x AS (SELECT DISTINCT 'services.description' AS field, id, description AS t FROM services UNION ALL SELECT DISTINCT 'products.name', id, name FROM products
                   UNION ALL SELECT DISTINCT 'products.description', id, description FROM products),
        w AS (SELECT field, id, unnest(regexp_extract_all(lower(nfc_normalize(t)), '[\\p{L}\\p{Nd}]+')) AS term FROM x WHERE t IS NOT NULL),
        f AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM w GROUP BY field, term)"""
_LATEST = "SELECT * FROM (SELECT DISTINCT query_id, table_name, access_count, last_accessed_at FROM query_stats) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY last_accessed_at DESC) = 1"
SQL = {
    "p1_found": _TEXTS + """, n AS (SELECT field, count(DISTINCT id) AS n FROM x WHERE t IS NOT NULL GROUP BY field)
        SELECT field, term, CASE WHEN records < 3 THEN 'rare' ELSE 'common' END AS mark FROM f JOIN n USING (field) WHERE records < 3 OR records >= n * 0.3""",
    "p1_ngrams": """
        WITH x AS (SELECT DISTINCT 'services.description' AS field, id, description AS t FROM services UNION ALL SELECT DISTINCT 'products.name', id, name FROM products
                   UNION ALL SELECT DISTINCT 'products.description', id, description FROM products),
        w AS (SELECT field, id, regexp_extract_all(lower(nfc_normalize(t)), '[\\p{L}\\p{Nd}]+') AS ws FROM x WHERE t IS NOT NULL),
        p AS (SELECT field, id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        g AS (SELECT field, id, array_to_string(ws[i:i + n - 1], ' ') AS ngram FROM p, (VALUES (1), (2), (3)) AS k(n) WHERE i + n - 1 <= len(ws))
        SELECT field, ngram, count(*) AS occurrences, count(DISTINCT id) AS records FROM g GROUP BY field, ngram""",
    "p1_terms": _TEXTS + " SELECT field, term, occurrences, records FROM f",
    "p2_found": """
        WITH m AS (SELECT DISTINCT id, table_name, query_type, CAST(execution_time_ms AS DOUBLE) AS ms FROM query_log WHERE table_name IS NOT NULL AND execution_time_ms >= 0)
        SELECT table_name, query_type FROM m GROUP BY table_name, query_type HAVING count(*) >= 50 AND quantile_cont(ms, 0.9) >= 8 * quantile_cont(ms, 0.5)""",
    "p5_found": f"""
        WITH q AS ({_LATEST})
        SELECT table_name, query_id FROM q WHERE table_name IS NOT NULL AND access_count IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY access_count DESC, last_accessed_at DESC, query_id ASC) <= 5""",
}

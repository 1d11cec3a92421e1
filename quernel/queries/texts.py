"""Queries of text and geo search, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.engine import Engine
from quernel.functions import geo as G
from quernel.functions import score as S
from quernel.functions import text as T
from quernel.functions.stem import stem
from quernel.operators import cluster, geosearch, index, places, search
from quernel.queries.model import CATALOG, engine
from quernel.session import new_path, spread, still_there, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Fixed values, written out for the SQL so that it shares none with the operators: stop words, separators, and the suffixes of steps 2 to 4.
_STOP = "'a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'have', 'he', 'in', 'is', 'it', 'its', 'of', 'on', 'that', 'the', 'they', 'this', 'to', 'was', 'will', 'with', 'but'"
_SEPARATORS = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}\\p{P}]+"
_SQL_STEP2 = "ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble"
_SQL_STEP3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
_SQL_STEP4 = "al, ance, ence, er, ic, able, ible, ant, ement, ment, ent, ion, ou, ism, ate, iti, ous, ive, ize"


def _pairs(text: str) -> dict[str, str]:
    return {a: b for a, _, b in (pair.partition(" ") for pair in text.split(", "))}




def _tokens_sql(source: str, key: str, text: str) -> str:
    """key, pos, term of the simple tokens."""
    words = f"list_filter(regexp_split_to_array(lower({text}), '{_SEPARATORS}'), lambda w: w <> '')"
    return f"""SELECT {key}, pos, term FROM (SELECT {key}, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT {key}, {words} AS w FROM {source} WHERE {text} IS NOT NULL))
        WHERE length(term) >= 3 AND regexp_matches(term, '[\\p{{L}}\\p{{N}}]') AND term NOT IN ({_STOP})"""


_DOC_TOKENS = _tokens_sql("documents", "doc_id", "text")


@query(f"SELECT doc_id, count(*) AS tokens, sum(pos) AS positions, count(DISTINCT term) AS terms FROM ({_DOC_TOKENS}) GROUP BY doc_id")
def tokenize_simple(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, the sum of their positions, and distinct terms of each document."""
    # a bound variable, so that the tokens are made once for all three figures
    figures = F.transform(F.array(T.simple_tokens(F.col("text"))), lambda t: F.struct(F.size(t).cast("long").alias("tokens"), F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + x["pos"]).alias("positions"), F.size(T.unique_terms(t)).cast("long").alias("terms")))
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.inline_outer(figures))
    return rows.where("tokens > 0")


@query("""
    WITH w AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name), '[\\s\\p{P}]+'), lambda w: w <> '')) AS word FROM part),
    g AS (SELECT p_partkey, unnest(CASE WHEN length(word) >= 3 THEN list_transform(range(1, length(word) - 1), lambda i: substring(word, i, 3)) ELSE [] END) AS gram FROM w)
    SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def tokenize_ngram(spark: SparkSession, d: str) -> DataFrame:
    """How often each run of three letters occurs in part names."""
    rows = table(spark, d, "part").select(F.inline(T.ngram_tokens(F.col("p_name"))))
    return rows.groupBy(F.col("term").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def _m(w: str) -> str:
    return f"len(regexp_extract_all({w}, '[aeiou][^aeiou]'))"


def _stem_sql(source: str) -> str:
    """word and stem of a table of words, a CTE per step."""
    cut = lambda n: f"left(w, greatest(length(w) - {n}, 0))"
    cvc = "[^aeiou][aeiou][^aeiouwxy]$"

    def fixed(s: str) -> str:
        return f"CASE WHEN regexp_matches({s}, '(at|bl|iz)$') THEN {s} || 'e' WHEN length({s}) > 1 AND right({s}, 1) = substring({s}, length({s}) - 1, 1) AND NOT regexp_matches({s}, '[aeiou]$') THEN left({s}, length({s}) - 1) WHEN {_m(s)} = 1 AND regexp_matches({s}, '{cvc}') THEN {s} || 'e' ELSE {s} END"

    one = f"""CASE WHEN suffix(w, 'sses') THEN {cut(2)} WHEN suffix(w, 'ies') THEN {cut(3)} || 'i' WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN {cut(1)}
        WHEN suffix(w, 'eed') AND {_m(cut(3))} > 0 THEN {cut(1)} WHEN suffix(w, 'ed') AND regexp_matches({cut(2)}, '[aeiou]') THEN {fixed(cut(2))}
        WHEN suffix(w, 'ing') AND regexp_matches({cut(3)}, '[aeiou]') THEN {fixed(cut(3))} ELSE w END"""
    swap = lambda pairs: "CASE " + " ".join(f"WHEN suffix(w, '{s}') AND {_m(cut(len(s)))} > 0 THEN {cut(len(s))} || '{r}'" for s, r in pairs.items()) + " ELSE w END"
    four = "CASE " + " ".join(f"WHEN suffix(w, '{s}') AND {_m(cut(len(s)))} > 1 THEN {cut(len(s))}" for s in _SQL_STEP4.split(', ')) + " ELSE w END"
    five = f"CASE WHEN suffix(w, 'e') AND ({_m(cut(1))} > 1 OR ({_m(cut(1))} = 1 AND NOT regexp_matches({cut(1)}, '{cvc}'))) THEN {cut(1)} WHEN suffix(w, 'll') AND {_m('w')} > 1 THEN {cut(1)} ELSE w END"
    out = f"SELECT word, word AS w FROM ({source})"
    for step in (one, swap(_pairs(_SQL_STEP2)), swap(_pairs(_SQL_STEP3)), four, five):
        out = f"SELECT word, {step} AS w FROM ({out})"
    return f"SELECT word, w AS stem FROM ({out})"


_WORDS = f"SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '{_SEPARATORS}'), lambda w: w <> '')) AS word FROM documents"


@query(_stem_sql(_WORDS))
def stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    """The stem of every word of the documents, as the tokeniser cuts them."""
    words = spread(table(spark, d, "documents").select("text")).select(F.explode(T.words_of(F.col("text"))).alias("word")).distinct()
    return words.select("word", stem(F.col("word")).alias("stem"))


_TITLE_TOKENS = _tokens_sql("services", "id", "title")


@query(f"WITH t AS (SELECT id, pos, term FROM ({_TITLE_TOKENS})), s AS ({_stem_sql(f'SELECT DISTINCT term AS word FROM ({_TITLE_TOKENS})')}) SELECT id, count(*) AS tokens, sum(pos) AS positions, count(DISTINCT stem) AS terms, min(stem) AS first FROM t JOIN s ON term = word GROUP BY id")
def tokenize_stemming(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed tokens of the services' titles, their positions and unique terms."""
    rows = table(spark, d, "services").select("id", T.stemmed_tokens(F.col("title")).alias("t")).select("id", "t", F.inline("t"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("tokens"), F.sum("pos").alias("positions"), F.countDistinct("term").alias("terms"), F.min(F.array_min(T.unique_terms(F.col("t")))).alias("first"))


_PART_WORDS = " UNION ALL ".join(f"SELECT p_partkey AS doc_id, {i} AS ord, {b} AS boost, term FROM ({_tokens_sql('part', 'p_partkey', f)})" for i, (f, b) in enumerate((("p_name", 3.0), ("p_type", 2.0), ("p_brand", 1.0))))
_PART_INDEX = f"SELECT doc_id, term, count(*) AS tf, count(*) * min_by(boost, ord) AS score FROM ({_PART_WORDS}) GROUP BY doc_id, term"
_DOC_INDEX = f"SELECT doc_id, term, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM ({_DOC_TOKENS}) GROUP BY doc_id, term"


_PART_FIELDS = {"p_name": 3.0, "p_type": 2.0, "p_brand": 1.0}


def _part_index(spark: SparkSession, d: str) -> DataFrame:
    return index.build_index(table(spark, d, "part"), "p_partkey", _PART_FIELDS)


#: Indexes written by this session with their paths, by application, data directory and table.
_written: dict[tuple[str, str, str], tuple[str, index.Written]] = {}


def _kept(spark: SparkSession, d: str, name: str, key: str, fields: dict[str, float]) -> index.Written:
    """The index of a table, written on first use; every lookup reads what was written."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _written or not still_there(spark, _written[at][0]):
        path = new_path(spark, f"index-{name}")
        _written[at] = path, index.write(table(spark, d, name), key, fields, "simple", path)
    return _written[at][1]


def _docs(spark: SparkSession, d: str) -> index.Written:
    return _kept(spark, d, "documents", "doc_id", {"text": 1.0})


def _parts(spark: SparkSession, d: str) -> index.Written:
    return _kept(spark, d, "part", "p_partkey", _PART_FIELDS)


@query(f"SELECT doc_id, term, tf, CAST(score AS DOUBLE) AS score FROM ({_PART_INDEX})")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The index of the parts' texts with boosts."""
    return _part_index(spark, d).select("doc_id", "term", "tf", "score")


@query(f"SELECT (SELECT count(*) FROM part) AS documents, (SELECT count(DISTINCT term) FROM ({_PART_WORDS})) AS terms, (SELECT count(*) FROM (SELECT DISTINCT doc_id, ord, term FROM ({_PART_WORDS}))) AS tokens")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents, terms and tokens of an index."""
    return _parts(spark, d).stats


@query(f"WITH i AS ({_PART_INDEX}), c AS (SELECT p_partkey AS doc_id FROM part WHERE p_size > 25) SELECT doc_id, count(*) AS terms, sum(tf) AS tf FROM i WHERE doc_id NOT IN (SELECT doc_id FROM c) GROUP BY doc_id")
def index_delete(spark: SparkSession, d: str) -> DataFrame:
    """The index without some documents."""
    gone = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("doc_id"))
    return index.delete_documents(_parts(spark, d).postings, gone).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tf"))


@query(f"WITH i AS ({_DOC_INDEX}) SELECT doc_id, CAST(tf AS DOUBLE) AS score FROM i WHERE term = 'refund' ORDER BY tf DESC, CAST(doc_id AS VARCHAR) DESC LIMIT 10")
def search_one_term(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for one term."""
    return index.search_index(_docs(spark, d).postings, ["refund"], 10)


@query(f"WITH i AS ({_DOC_INDEX}) SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM i WHERE term IN ('cache', 'query', 'table') GROUP BY doc_id HAVING count(*) = 3 ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC LIMIT 20")
def search_all_terms(spark: SparkSession, d: str) -> DataFrame:
    """The best documents that hold all terms."""
    return index.search_index(_docs(spark, d).postings, index.query_terms(table(spark, d, "documents"), "the Cache, query to table!"), 20)


def _score_sql(fields: list[str], terms: list[str]) -> str:
    hit = " + ".join(f"CASE WHEN coalesce({f}, '') = '' THEN 0.0 WHEN regexp_matches(lower({f}), '\\b{t}\\b') THEN 1.5 WHEN contains(lower({f}), '{t}') THEN 1.0 ELSE 0.0 END" for f in fields for t in terms)
    n = " + ".join(f"CASE WHEN coalesce({f}, '') = '' THEN 0 ELSE {len(terms)} END" for f in fields)
    return f"CASE WHEN {n} > 0 THEN ({hit}) / ({n}) ELSE 0.0 END"


@query(f"""
    WITH i AS ({_DOC_INDEX}), t AS (SELECT doc_id, sum(tf) AS s FROM i WHERE term IN ('provider', 'order') GROUP BY doc_id HAVING count(*) = 2 ORDER BY s DESC, CAST(doc_id AS VARCHAR) DESC LIMIT 40)
    SELECT doc_id, source, round(CAST({_score_sql(['text'], ['provider', 'order'])} AS DOUBLE), 6) AS score FROM documents JOIN t USING (doc_id) WHERE lang = 'en'""")
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A search whose page is filtered after it is cut."""
    e = engine(spark, d, "documents")
    return e.documents.search("provider order", limit=40, filters={"lang": "en"}).select("doc_id", "source", "score")


@query(f"""
    WITH i AS ({_DOC_INDEX}), t AS (SELECT doc_id FROM i WHERE term IN ('provider', 'order') GROUP BY doc_id HAVING count(*) = 2 ORDER BY sum(tf) DESC, CAST(doc_id AS VARCHAR) DESC LIMIT 15 OFFSET 5)
    SELECT doc_id, 'provider order' AS matched, regexp_replace(text, '(?i)\\b(provider|order)\\b', '<mark>\\1</mark>', 'g') AS marked FROM documents JOIN t USING (doc_id)""")
def search_matched(spark: SparkSession, d: str) -> DataFrame:
    """A later page of a search with its matched terms and highlights."""
    found = engine(spark, d, "documents").documents.search("Provider order", limit=15, offset=5, highlight_fields=["text"])
    return found.select("doc_id", F.array_join("matched_terms", " ").alias("matched"), F.element_at("highlights", "text").alias("marked"))


@query(f"SELECT doc_id, pos, term FROM ({_tokens_sql('(SELECT p_partkey AS doc_id, p_name AS text FROM part)', 'doc_id', 'text')})")
def tokenize_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by a tokeniser that there is not: the simple ones."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.inline(T.tokens_of(F.col("p_name"), "no such tokeniser"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


@query(f"SELECT id, round(CAST({_score_sql(['title', 'description'], ['clean', 'roof'])} AS DOUBLE), 6) AS score FROM services")
def simple_score(spark: SparkSession, d: str) -> DataFrame:
    """The plain score of every service."""
    return table(spark, d, "services").select("id", F.round(S.simple_score([F.col("title"), F.col("description")], "clean roof"), 6).alias("score"))


@query(r"SELECT p_partkey, regexp_replace(p_name, '(?i)\b(blue|green|red)\b', '<mark>\1</mark>', 'g') AS marked FROM part")
def highlight(spark: SparkSession, d: str) -> DataFrame:
    """Part names with hits marked."""
    return table(spark, d, "part").select("p_partkey", S.highlight(F.col("p_name"), ["blue", "green", "red"]).alias("marked"))


@query(r"""
    WITH a AS (SELECT doc_id, text AS t, length(text) AS n, least(nullif(instr(lower(text), 'provider'), 0), nullif(instr(lower(text), 'index'), 0)) - 1 AS hit FROM documents WHERE text IS NOT NULL),
    b AS (SELECT *, greatest(hit - 65, 0) AS s, least(hit + 65, n) AS e FROM a),
    c AS (SELECT *, CASE WHEN s > 0 AND instr(left(t, s + 1), ' ') > 0 THEN s + 1 - instr(reverse(left(t, s + 1)), ' ') + 1 ELSE s END AS s2, CASE WHEN e < n AND instr(substring(t, e + 1), ' ') > 0 THEN e + instr(substring(t, e + 1), ' ') - 1 ELSE e END AS e2 FROM b)
    SELECT doc_id, CASE WHEN hit IS NULL THEN left(t, 150) || CASE WHEN n > 150 THEN '...' ELSE '' END
        ELSE regexp_replace(CASE WHEN s2 > 0 THEN '...' ELSE '' END || substring(t, s2 + 1, e2 - s2) || CASE WHEN e2 < n THEN '...' ELSE '' END, '(?i)\b(provider|index)\b', '<mark>\1</mark>', 'g') END AS snippet FROM c
    UNION ALL SELECT doc_id, '' FROM documents WHERE text IS NULL""")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    """The surroundings of the first hit in each document."""
    return table(spark, d, "documents").select("doc_id", S.snippet(F.col("text"), ["provider", "index"]).alias("snippet"))


@query(f"WITH i AS ({_DOC_INDEX}), n AS (SELECT count(DISTINCT doc_id) AS n FROM i) SELECT doc_id, term, round(tf * ln((n + 1) / (count(*) OVER (PARTITION BY term) + 1)), 6) AS value FROM i, n WHERE term IN ('cache', 'query', 'table')")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF of some terms."""
    return index.tf_idf_scores(_docs(spark, d), ["cache", "query", "table"]).withColumn("value", F.round("value", 6))


@query(f"""
    WITH i AS ({_DOC_INDEX}), l AS (SELECT doc_id, sum(tf) AS len FROM i GROUP BY doc_id), a AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
    h AS (SELECT doc_id, tf, count(*) OVER (PARTITION BY term) AS df FROM i WHERE term IN ('cache', 'query', 'table'))
    SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN l USING (doc_id), a GROUP BY doc_id""")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of some terms."""
    return index.bm25_scores(_docs(spark, d), ["cache", "query", "table"]).withColumn("score", F.round("score", 6))


@query(f"""
    WITH h AS (SELECT * FROM ({_DOC_TOKENS}) WHERE term IN ('cache', 'query')), a AS (SELECT doc_id, pos FROM h WHERE term = 'cache'), b AS (SELECT doc_id, pos FROM h WHERE term = 'query'),
    m AS (SELECT doc_id, a.pos, min(abs(a.pos - b.pos)) AS gap FROM a JOIN b USING (doc_id) GROUP BY doc_id, a.pos), s AS (SELECT doc_id, min(gap) AS span FROM m GROUP BY doc_id)
    SELECT doc_id, CAST(CASE WHEN span IS NULL THEN 0 WHEN span = 0 THEN 1 WHEN span <= 2 THEN 0.9 WHEN span <= 5 THEN 0.7 WHEN span <= 10 THEN 0.5 WHEN span <= 20 THEN 0.3 ELSE 0.1 END AS DOUBLE) AS score
    FROM (SELECT DISTINCT doc_id FROM h) LEFT JOIN s USING (doc_id)""")
def proximity(spark: SparkSession, d: str) -> DataFrame:
    """How close two terms stand."""
    return index.proximity_scores(_docs(spark, d).postings, ["cache", "query"])


@query(f"""
    WITH h AS (SELECT * FROM ({_DOC_TOKENS})), a AS (SELECT doc_id, min(abs(x.pos - y.pos)) AS gap FROM (SELECT * FROM h WHERE term = 'index') x JOIN (SELECT * FROM h WHERE term = 'table') y USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(CASE WHEN gap IS NULL THEN 0 WHEN gap = 1 THEN 1 WHEN gap <= 3 THEN 0.8 WHEN gap <= 10 THEN 0.5 WHEN gap <= 50 THEN 0.2 ELSE 0.1 END AS DOUBLE) AS score FROM documents LEFT JOIN a USING (doc_id)""")
def pair_proximity(spark: SparkSession, d: str) -> DataFrame:
    """The nearest distance of two terms in each document as a score."""
    return table(spark, d, "documents").select("doc_id", T.pair_proximity(T.simple_tokens(F.col("text")), "index", "table").alias("score"))


def _ranked_sql(terms: tuple[str, str], boost: float) -> str:
    """doc_id and the mean combined score of two terms, of which the first found one leads."""
    a, b = terms
    return f"""
    WITH i AS ({_DOC_INDEX}), n AS (SELECT count(DISTINCT doc_id) AS n FROM i), h AS (SELECT doc_id, term, tf, positions, count(*) OVER (PARTITION BY term) AS df FROM i WHERE term IN ('{a}', '{b}')),
    g AS (SELECT x.doc_id, (SELECT min(least_gap) FROM (SELECT min(abs(p - q)) AS least_gap FROM (SELECT unnest(x.positions) AS p), (SELECT unnest(y.positions) AS q) GROUP BY p)) AS span FROM (SELECT * FROM h WHERE term = '{a}') x JOIN (SELECT * FROM h WHERE term = '{b}') y USING (doc_id)),
    p AS (SELECT doc_id, CASE WHEN span = 0 THEN 1.0 WHEN span <= 2 THEN 0.9 WHEN span <= 5 THEN 0.7 WHEN span <= 10 THEN 0.5 WHEN span <= 20 THEN 0.3 ELSE 0.1 END AS near FROM g)
    SELECT doc_id, avg(least(1.0, (tf * ln((n + 1) / (df + 1)) + {boost} + 0.5 * coalesce(near, 0)) / 10)) AS score FROM h JOIN n ON true LEFT JOIN p USING (doc_id) GROUP BY doc_id"""


@query(f"SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM ({_ranked_sql(('cache', 'query'), 1.0)})")
def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the combined score."""
    return index.ranked(_docs(spark, d), ["cache", "query"]).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, round(exp(-epoch(TIMESTAMP '2024-06-01 00:00:00' - created_on) / 86400.0 / 30), 6) AS score FROM documents WHERE created_on IS NOT NULL UNION ALL SELECT doc_id, 0.0 FROM documents WHERE created_on IS NULL")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    """How fresh each document is at an instant."""
    score = S.freshness(F.col("created_on"), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query(f"WITH i AS ({_DOC_INDEX}) SELECT DISTINCT doc_id FROM i WHERE term = 'refund'")
def index_documents_of(spark: SparkSession, d: str) -> DataFrame:
    """All documents that hold a term."""
    return index.documents_of(_docs(spark, d).postings, "refund", 0)


@query(f"SELECT DISTINCT term FROM ({_DOC_TOKENS})")
def index_all_terms(spark: SparkSession, d: str) -> DataFrame:
    """All terms of an index."""
    return index.all_terms(_docs(spark, d).postings, 0)


_NEW_WORDS = " UNION ALL ".join(f"SELECT p_partkey AS doc_id, {i} AS ord, {b} AS boost, term FROM ({_tokens_sql('(SELECT p_partkey, CASE WHEN p_size > 25 THEN ' + repr('renewed ') + ' || p_name ELSE p_name END AS p_name, p_type, p_brand FROM part)', 'p_partkey', f)})" for i, (f, b) in enumerate((("p_name", 3.0), ("p_type", 2.0), ("p_brand", 1.0))))


@query(f"SELECT doc_id, term, count(*) AS tf, CAST(count(*) * min_by(boost, ord) AS DOUBLE) AS score FROM ({_NEW_WORDS}) GROUP BY doc_id, term")
def index_update(spark: SparkSession, d: str) -> DataFrame:
    """The index after some documents were changed."""
    changed = table(spark, d, "part").where("p_size > 25").withColumn("p_name", F.concat(F.lit("renewed "), "p_name"))
    return index.update_documents(_parts(spark, d).postings, changed, "p_partkey", _PART_FIELDS).select("doc_id", "term", "tf", "score")


@query("SELECT CAST(NULL AS VARCHAR) AS step, CAST(NULL AS BIGINT) AS n WHERE false UNION ALL VALUES ('before', 0), ('built', 1), ('cleared', 0), ('all built', 1), ('after a write', 0), ('searched', 1)")
def index_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether an index is there while it is built, cleared, made stale by a write and used again."""
    e = engine(spark, d, "part")
    told = [("before", e.part.has_search_index())]
    e.part.build_search_index()
    told.append(("built", e.part.has_search_index()))
    e.part.clear_search_index()
    told.append(("cleared", e.part.has_search_index()))
    assert e.build_all_indexes() == {}
    told.append(("all built", e.part.has_search_index()))
    e.part.update_many({"p_partkey": 1}, {"p_name": "renewed"})
    told.append(("after a write", e.part.has_search_index()))
    e.part.search("renewed").count()
    told.append(("searched", e.part.has_search_index()))
    return spark.createDataFrame([(step, int(there)) for step, there in told], "step string, n long")


@query("SELECT title AS suggestion, count(*) AS n FROM services WHERE starts_with(lower(title), 're') GROUP BY title ORDER BY n DESC, title LIMIT 10")
def autocomplete_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent titles with a prefix."""
    return search.suggestions(table(spark, d, "services"), "title", "Re", 10)


@query("SELECT 'category' AS facet, category AS value, count(*) AS n FROM services GROUP BY category UNION ALL SELECT 'is_active', CAST(is_active AS VARCHAR), count(*) FROM services GROUP BY is_active")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many services each category and state has."""
    return search.facets(table(spark, d, "services"), ["category", "is_active"])


@query("SELECT CASE WHEN price < 50 THEN 'low' WHEN price < 150 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM services WHERE price IS NOT NULL GROUP BY 1")
def facet_ranges(spark: SparkSession, d: str) -> DataFrame:
    """How many services lie in each range of prices."""
    return search.range_facets(table(spark, d, "services"), "price", {"low": (None, 50), "middle": (50, 150), "high": (150, None)})


@query()
def fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    """All terms that are nearly a given one, in any script, by characters (DuckDB counts edits by bytes, so there is no SQL)."""
    return search.fuzzy_terms(_docs(spark, d).postings, "cache", 2).withColumn("edits", F.col("edits").cast("long"))


@query(f"WITH s AS (SELECT {_score_sql(['title', 'description'], ['clean', 'roof'])} * 100 AS s FROM services) SELECT CASE WHEN s >= 80 THEN '80-100' WHEN s >= 50 THEN '50-79' ELSE '0-49' END AS band, count(*) AS n FROM s GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Services per band of their score."""
    return search.score_bands(table(spark, d, "services").withColumn("score", S.simple_score([F.col("title"), F.col("description")], "clean roof")))


_GEO = "SELECT geo_id, location.lat AS lat, location.lng AS lng, location_name FROM geo_documents"
_OK = "lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180"


def _d(lat: str, lng: str, clat: object, clng: object) -> str:
    return f"(12742.0 * asin(least(1.0, sqrt(sin(radians({clat} - {lat}) / 2) ** 2 + cos(radians({lat})) * cos(radians({clat})) * sin(radians({clng} - {lng}) / 2) ** 2))))"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "geo_documents").select("geo_id", "location.lat", "location.lng", "location_name")


_AT = (51.5074, -0.1278)


@query(f"SELECT geo_id, round({_d('lat', 'lng', *_AT)}, 3) AS km FROM ({_GEO}) WHERE {_OK}")
def geo_distance(spark: SparkSession, d: str) -> DataFrame:
    """The distance of every point to one place."""
    rows = _points(spark, d).where(G.valid(F.col("lat"), F.col("lng")))
    return rows.select("geo_id", F.round(G.distance(F.col("lat"), F.col("lng"), *_AT), 3).alias("km"))


@query(f"SELECT geo_id, round({_d('lat', 'lng', *_AT)}, 3) AS km FROM ({_GEO}) WHERE {_OK} AND {_d('lat', 'lng', *_AT)} <= 1500")
def geo_radius(spark: SparkSession, d: str) -> DataFrame:
    """Points within a radius."""
    return geosearch.by_radius(_points(spark, d), "geo_id", "lat", "lng", _AT, 1500).select("geo_id", F.round("distance", 3).alias("km"))


@query(f"WITH p AS (SELECT geo_id, {_d('lat', 'lng', *_AT)} AS km FROM ({_GEO}) WHERE {_OK}), n AS (SELECT count(*) AS n FROM p WHERE km <= 1) SELECT geo_id, round(km, 3) AS km, round(CASE WHEN n < 5 THEN (1 - km / 2500) * CASE WHEN km > 1 THEN 0.7 ELSE 1 END ELSE 1 - km END, 6) AS relevance FROM p, n WHERE km <= CASE WHEN n < 5 THEN 2500 ELSE 1 END")
def geo_radius_expand(spark: SparkSession, d: str) -> DataFrame:
    """A search that widens when it finds too little."""
    found = geosearch.by_radius(_points(spark, d), "geo_id", "lat", "lng", _AT, 1, max_range=2500)
    return found.select("geo_id", F.round("distance", 3).alias("km"), F.round("relevance", 6).alias("relevance"))


@query(f"WITH p AS (SELECT geo_id, {_d('lat', 'lng', *_AT)} AS km FROM ({_GEO}) WHERE {_OK}) SELECT geo_id, round((1 - km / 2000) * CASE WHEN km <= 300 THEN 2.0 WHEN km <= 900 THEN 1.5 ELSE 1 END, 6) AS relevance FROM p WHERE km <= 2000")
def geo_relevance_boost(spark: SparkSession, d: str) -> DataFrame:
    """Relevance with boosts for near points."""
    found = geosearch.by_radius(_points(spark, d), "geo_id", "lat", "lng", _AT, 2000, boosts=[(300, 2.0), (900, 1.5)])
    return found.select("geo_id", F.round("relevance", 6).alias("relevance"))


@query(f"SELECT geo_id FROM ({_GEO}) WHERE lat BETWEEN 40 AND 60 AND lng BETWEEN -10 AND 20")
def geo_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Points in a box."""
    return _points(spark, d).where(G.within_bounds(F.col("lat"), F.col("lng"), 40, -10, 60, 20)).select("geo_id")


_B = "SELECT bucket_no, bucket_id, center.lat AS blat, center.lng AS blng, radius.value * CASE radius.unit WHEN 'km' THEN 1.0 WHEN 'mi' THEN 1.609344 ELSE 0.001 END AS km FROM geo_buckets"


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    unit = F.col("radius.unit")
    km = F.when(unit == "km", 1.0).when(unit == "mi", 1.609344).otherwise(0.001) * F.col("radius.value")
    return table(spark, d, "geo_buckets").select(F.col("bucket_no").alias("ord"), "bucket_id", "center.lat", "center.lng", km.alias("radius_km"))


@query(f"WITH p AS (SELECT * FROM ({_GEO}) WHERE {_OK}), b AS ({_B}) SELECT geo_id, min_by(bucket_id, bucket_no) AS bucket_id FROM p LEFT JOIN b ON {_d('lat', 'lng', 'blat', 'blng')} <= km GROUP BY geo_id")
def geo_bucket_assign(spark: SparkSession, d: str) -> DataFrame:
    """The first bucket that holds each point."""
    found = geosearch.geo_index(_points(spark, d), "geo_id", "lat", "lng", _buckets(spark, d))
    return found.select("geo_id", "bucket_id").distinct()


@query(f"WITH b AS ({_B}) SELECT bucket_id FROM b WHERE {_d('blat', 'blng', *_AT)} <= greatest(1200, km)")
def geo_buckets_meeting(spark: SparkSession, d: str) -> DataFrame:
    """Buckets that meet a circle."""
    return geosearch.buckets_meeting(_buckets(spark, d), _AT, 1200).select("bucket_id")


@query(f"""
    WITH p AS (SELECT location_name, radians(lat) AS a, radians(lng) AS o FROM ({_GEO}) WHERE {_OK}), m AS (SELECT location_name, count(*) AS n, avg(cos(a) * cos(o)) AS x, avg(cos(a) * sin(o)) AS y, avg(sin(a)) AS z FROM p GROUP BY location_name)
    SELECT location_name, n, CASE WHEN x * x + y * y + z * z > 1e-24 THEN round(degrees(atan2(z, sqrt(x * x + y * y))), 4) END AS lat, CASE WHEN x * x + y * y + z * z > 1e-24 THEN round(degrees(atan2(y, x)), 4) END AS lng FROM m""")
def geo_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The middle of the points of every place name; null where their directions cancel out."""
    rows = _points(spark, d).where(G.valid(F.col("lat"), F.col("lng"))).groupBy("location_name")
    lat, lng = G.centroid(F.col("lat"), F.col("lng"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(lat, 4).alias("lat"), F.round(lng, 4).alias("lng"))


@query(f"SELECT location_name, min(lat) AS south, min(lng) AS west, max(lat) AS north, max(lng) AS east FROM ({_GEO}) WHERE {_OK} GROUP BY location_name")
def geo_box_of(spark: SparkSession, d: str) -> DataFrame:
    """The box round the points of every place name."""
    return _points(spark, d).where(G.valid(F.col("lat"), F.col("lng"))).groupBy("location_name").agg(*G.box_of(F.col("lat"), F.col("lng")))


@query("WITH b AS (SELECT bucket_no, radius.value AS v, radius.unit AS u, radius.value * CASE radius.unit WHEN 'km' THEN 1000.0 WHEN 'mi' THEN 1609.34 ELSE 1.0 END AS m FROM geo_buckets) SELECT bucket_no, round(m / 1000.0, 6) AS km, round(m / 1609.34, 6) AS mi FROM b")
def geo_convert(spark: SparkSession, d: str) -> DataFrame:
    """The radius of each bucket in kilometres and miles."""
    to = lambda unit: reduce(lambda out, u: F.when(F.col("radius.unit") == u, G.convert(F.col("radius.value"), u, unit)).otherwise(out), ("km", "mi", "m"), F.lit(None).cast("double"))
    return table(spark, d, "geo_buckets").select("bucket_no", F.round(to("km"), 6).alias("km"), F.round(to("mi"), 6).alias("mi"))


def _mi(lat: str, lng: str, clat: object, clng: object) -> str:
    return _d(lat, lng, clat, clng).replace("12742.0", "7918.0")


@query(f"SELECT geo_id, round({_mi('lat', 'lng', *_AT)}, 3) AS mi, round(1 - {_mi('lat', 'lng', *_AT)} / 900, 6) AS relevance FROM ({_GEO}) WHERE {_OK} AND {_mi('lat', 'lng', *_AT)} <= 900")
def geo_radius_miles(spark: SparkSession, d: str) -> DataFrame:
    """Points within a radius in miles, with distances in miles."""
    found = geosearch.by_radius(_points(spark, d), "geo_id", "lat", "lng", _AT, 900, "mi")
    return found.select("geo_id", F.round("distance", 3).alias("mi"), F.round("relevance", 6).alias("relevance"))


@query(f"SELECT geo_id, round({_d('lat', 'lng', 51.5074, -0.1278)}, 3) AS km FROM ({_GEO}) WHERE {_OK} AND {_d('lat', 'lng', 51.5074, -0.1278)} <= 2000")
def geo_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Points round a place given by one of its other names."""
    found = engine(spark, d, "geo_documents").geo_documents.search_geo({"locationName": "The Big Smoke", "radius": {"value": 2000, "unit": "km"}})
    return found.select("geo_id", F.round("distance", 3).alias("km"))


@query(f"WITH b AS ({_B}), c AS (SELECT * FROM b WHERE km = (SELECT max(km) FROM b) ORDER BY bucket_id LIMIT 1) SELECT geo_id, round({_d('lat', 'lng', 'blat', 'blng')}, 3) AS km FROM ({_GEO}), c WHERE {_OK} AND {_d('lat', 'lng', 'blat', 'blng')} <= c.km")
def geo_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Points within the circle of the widest bucket, given by its id."""
    held = _buckets(spark, d)
    widest = held.orderBy(F.desc("radius_km"), "bucket_id").first().bucket_id
    found = geosearch.search_geo(_points(spark, d).where(G.valid(F.col("lat"), F.col("lng"))), "geo_id", "lat", "lng", {"bucketId": widest}, buckets=held)
    return found.select("geo_id", F.round("distance", 3).alias("km"))


@query(f"WITH p AS (SELECT * FROM ({_GEO}) WHERE {_OK}), b AS ({_B}), h AS (SELECT geo_id, lat, lng, location_name, min_by(bucket_id, bucket_no) AS bucket_id FROM p LEFT JOIN b ON {_d('lat', 'lng', 'blat', 'blng')} <= km GROUP BY ALL), r AS (SELECT bucket_id FROM p JOIN h USING (geo_id)) SELECT (SELECT count(*) FROM p) AS documents, (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM b WHERE {_d('lat', 'lng', 'blat', 'blng')} <= km)) AS in_buckets, (SELECT count(DISTINCT bucket_id) FROM h) AS buckets, -90.0 AS south, -180.0 AS west, 90.0 AS north, 180.0 AS east".replace(", r AS (SELECT bucket_id FROM p JOIN h USING (geo_id))", ""))
def geo_index_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a geo index."""
    return geosearch.geo_totals(geosearch.geo_index(_points(spark, d), "geo_id", "lat", "lng", _buckets(spark, d)))


_BOXES = "SELECT bucket_no, bucket_id, center.lat AS blat, center.lng AS blng, radius.value / 1000 AS km, center.lat - 2 AS south, center.lng - 3 AS west, center.lat + 2 AS north, center.lng + 3 AS east FROM geo_buckets"
_IN_BOX = "lat BETWEEN south AND north AND lng BETWEEN west AND east"


@query(f"WITH p AS (SELECT DISTINCT * FROM ({_GEO}) WHERE {_OK}), b AS ({_BOXES}) SELECT geo_id, lat, lng, min_by(bucket_id, bucket_no) AS bucket_id FROM p LEFT JOIN b ON {_d('lat', 'lng', 'blat', 'blng')} <= km OR ({_IN_BOX}) GROUP BY geo_id, lat, lng")
def geo_bucket_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The first bucket whose circle or box holds each point, looked up by cells of space."""
    held = table(spark, d, "geo_buckets").select(F.col("bucket_no").alias("ord"), "bucket_id", "center.lat", "center.lng", (F.col("radius.value") / 1000).alias("radius_km"))
    held = held.select("*", (F.col("lat") - 2).alias("south"), (F.col("lng") - 3).alias("west"), (F.col("lat") + 2).alias("north"), (F.col("lng") + 3).alias("east"))
    points = _points(spark, d).where(G.valid(F.col("lat"), F.col("lng")))
    return places.first_bucket(points, "geo_id", "lat", "lng", held, most=10).select("geo_id", "lat", "lng", "bucket_id").distinct()


@query(f"WITH b AS ({_BOXES}) SELECT bucket_id FROM b WHERE {_d('blat', 'blng', *_AT)} <= greatest(1500, km) OR (north >= {_AT[0]} - degrees(1500 / 6371.0) AND south <= {_AT[0]} + degrees(1500 / 6371.0) AND east >= {_AT[1]} - degrees(1500 / 6371.0) / cos(radians({_AT[0]})) AND west <= {_AT[1]} + degrees(1500 / 6371.0) / cos(radians({_AT[0]})))")
def geo_boxes_meeting(spark: SparkSession, d: str) -> DataFrame:
    """Buckets with boxes that meet a circle."""
    held = table(spark, d, "geo_buckets").select("bucket_id", "center.lat", "center.lng", (F.col("radius.value") / 1000).alias("radius_km"))
    held = held.select("*", (F.col("lat") - 2).alias("south"), (F.col("lng") - 3).alias("west"), (F.col("lat") + 2).alias("north"), (F.col("lng") + 3).alias("east"))
    return geosearch.buckets_meeting(held, _AT, 1500).select("bucket_id")


@query(f"SELECT round(lat, 4) AS lat, round(lng, 4) AS lng, count(*) AS n FROM ({_GEO}) WHERE lat BETWEEN 0 AND 45 AND lng BETWEEN 0 AND 90 GROUP BY 1, 2")
def geo_map_listing(spark: SparkSession, d: str) -> DataFrame:
    """Distinct coordinates in a box."""
    return geosearch.map_listing(_points(spark, d), "lat", "lng", 0, 0, 45, 90)


@query(f"SELECT CAST(floor(lat / (50.0 / 111)) AS BIGINT) AS y, CAST(floor(lng / (50.0 / 111)) AS BIGINT) AS x, count(*) AS n FROM ({_GEO}) WHERE {_OK} GROUP BY 1, 2 HAVING count(*) >= 3")
def geo_grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Grid cells with enough points."""
    g = 50.0 / cluster.DEGREE_KM
    rows = cluster.grid_cells(_points(spark, d), "lat", "lng", 50.0).groupBy(F.round(F.col("cell_lat") / g).cast("long").alias("y"), F.round(F.col("cell_lng") / g).cast("long").alias("x"))
    return rows.agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query()
def geo_grid_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of the points by grid and k-means."""
    found = cluster.buckets(_points(spark, d).dropDuplicates(["geo_id"]), "geo_id", "lat", "lng", "location_name", 5, 50.0, 3)
    return found.select("bucket_id", "n", "location_name", F.round("radius_km", 6).alias("radius_km"), F.size("members").alias("size"))


_CELLS = f"""
    p AS (SELECT geo_id, any_value(lat) AS lat, any_value(lng) AS lng, lower(any_value(location_name)) AS name FROM ({_GEO}) WHERE {_OK} GROUP BY geo_id),
    c AS (SELECT *, CAST(floor(lat / (50.0 / 111)) AS BIGINT) AS y, CAST(floor(lng / (50.0 / 111)) AS BIGINT) AS x FROM p),
    m AS (SELECT y, x, count(*) AS n, avg(lat) AS clat, avg(lng) AS clng, min(lat) AS south, min(lng) AS west, max(lat) AS north, max(lng) AS east FROM c GROUP BY y, x HAVING count(*) >= 3),
    f AS (SELECT y, x, max({_d('lat', 'lng', 'clat', 'clng')}) * 1.1 AS radius_km FROM c JOIN m USING (y, x) GROUP BY y, x),
    o AS (SELECT y, x, name FROM (SELECT y, x, name, row_number() OVER (PARTITION BY y, x ORDER BY count(*) DESC, name) AS k FROM c WHERE name IS NOT NULL GROUP BY y, x, name) WHERE k = 1),
    b AS (SELECT m.*, radius_km, name AS location_name FROM m JOIN f USING (y, x) LEFT JOIN o USING (y, x))"""


def _whole_cells(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of cells of which none is divided."""
    return cluster.buckets(_points(spark, d).dropDuplicates(["geo_id"]), "geo_id", "lat", "lng", "location_name", 1_000_000_000, 50.0, 3)


@query(f"WITH {_CELLS} SELECT n, round(clat, 8) AS lat, round(clng, 8) AS lng, round(radius_km, 5) AS radius_km, south, west, north, east, location_name, n AS members FROM b")
def geo_cell_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Centre, radius, box, members and commonest name of whole cells."""
    found = _whole_cells(spark, d)
    return found.select("n", F.round("lat", 8).alias("lat"), F.round("lng", 8).alias("lng"), F.round("radius_km", 5).alias("radius_km"), "south", "west", "north", "east", "location_name", F.size("members").cast("long").alias("members"))


@query(f"WITH {_CELLS} SELECT count(*) AS buckets, round(avg(n), 1) AS mean_size, min(n) AS least, max(n) AS most, sum(n) AS members FROM b")
def geo_cell_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the buckets of whole cells."""
    return cluster.bucket_stats(_whole_cells(spark, d))


@query(f"WITH {_CELLS} SELECT location_name, count(*) AS buckets, sum(n) AS members FROM b GROUP BY location_name")
def geo_cell_places(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of whole cells and their members per place name."""
    return cluster.bucket_places(_whole_cells(spark, d))


@query()
def geo_cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the buckets."""
    return cluster.bucket_stats(cluster.buckets(_points(spark, d).dropDuplicates(["geo_id"]), "geo_id", "lat", "lng", "location_name", 5, 50.0, 3))


# Fixed values, written out for the SQL: known places and their other names as (place in the list, key, canonical name).
_PLACES = """
    (0, 'new york city', 'New York City'), (1, 'los angeles', 'Los Angeles'), (2, 'chicago', 'Chicago'), (3, 'houston', 'Houston'), (4, 'phoenix', 'Phoenix'),
    (5, 'san francisco', 'San Francisco'), (6, 'seattle', 'Seattle'), (7, 'miami', 'Miami'), (8, 'boston', 'Boston'), (9, 'london', 'London'), (10, 'paris', 'Paris'),
    (11, 'tokyo', 'Tokyo'), (12, 'mumbai', 'Mumbai'), (13, 'delhi', 'Delhi'), (14, 'bangalore', 'Bangalore'), (15, 'the big apple', 'New York City'),
    (16, 'sin city', 'Las Vegas'), (17, 'motor city', 'Detroit'), (18, 'music city', 'Nashville'), (19, 'the mile high city', 'Denver'),
    (20, 'the emerald city', 'Seattle'), (21, 'the city of angels', 'Los Angeles'), (22, 'the windy city', 'Chicago'), (23, 'philly', 'Philadelphia'),
    (24, 'atx', 'Austin'), (25, 'the big smoke', 'London'), (26, 'the city of light', 'Paris'), (27, 'the big mango', 'Bangkok'), (28, 'the big durian', 'Jakarta')"""
_PLACE_ALIAS = """
    (0, 'nyc', 'New York City'), (0, 'new york', 'New York City'), (0, 'manhattan', 'New York City'), (0, 'brooklyn', 'New York City'), (0, 'queens', 'New York City'),
    (0, 'bronx', 'New York City'), (0, 'staten island', 'New York City'), (1, 'la', 'Los Angeles'), (1, 'los angeles', 'Los Angeles'), (1, 'hollywood', 'Los Angeles'),
    (1, 'santa monica', 'Los Angeles'), (1, 'venice', 'Los Angeles'), (2, 'chicago', 'Chicago'), (2, 'chitown', 'Chicago'), (2, 'the windy city', 'Chicago'),
    (3, 'houston', 'Houston'), (3, 'htown', 'Houston'), (4, 'phoenix', 'Phoenix'), (4, 'phx', 'Phoenix'), (5, 'sf', 'San Francisco'),
    (5, 'san francisco', 'San Francisco'), (5, 'san fran', 'San Francisco'), (5, 'the city', 'San Francisco'), (6, 'seattle', 'Seattle'), (6, 'sea', 'Seattle'),
    (7, 'miami', 'Miami'), (7, 'mia', 'Miami'), (7, 'miami beach', 'Miami'), (8, 'boston', 'Boston'), (8, 'bos', 'Boston'), (9, 'london', 'London'), (9, 'ldn', 'London'),
    (10, 'paris', 'Paris'), (10, 'par', 'Paris'), (11, 'tokyo', 'Tokyo'), (11, 'tyo', 'Tokyo'), (12, 'mumbai', 'Mumbai'), (12, 'bombay', 'Mumbai'), (12, 'bom', 'Mumbai'),
    (13, 'delhi', 'Delhi'), (13, 'new delhi', 'Delhi'), (13, 'del', 'Delhi'), (14, 'bangalore', 'Bangalore'), (14, 'bengaluru', 'Bangalore'), (14, 'blr', 'Bangalore'),
    (15, 'big apple', 'New York City'), (15, 'nyc', 'New York City'), (16, 'vegas', 'Las Vegas'), (16, 'lv', 'Las Vegas'), (16, 'las vegas', 'Las Vegas'),
    (17, 'the d', 'Detroit'), (17, 'detroit', 'Detroit'), (17, 'dtw', 'Detroit'), (18, 'nash', 'Nashville'), (18, 'nashville', 'Nashville'), (18, 'bna', 'Nashville'),
    (19, 'denver', 'Denver'), (19, 'den', 'Denver'), (20, 'seattle', 'Seattle'), (20, 'sea', 'Seattle'), (21, 'la', 'Los Angeles'), (21, 'los angeles', 'Los Angeles'),
    (21, 'lax', 'Los Angeles'), (22, 'chicago', 'Chicago'), (22, 'chitown', 'Chicago'), (22, 'ord', 'Chicago'), (23, 'philadelphia', 'Philadelphia'),
    (23, 'phl', 'Philadelphia'), (24, 'austin', 'Austin'), (24, 'atx', 'Austin'), (25, 'london', 'London'), (25, 'ldn', 'London'), (26, 'paris', 'Paris'),
    (26, 'cdg', 'Paris'), (27, 'bangkok', 'Bangkok'), (27, 'bkk', 'Bangkok'), (28, 'jakarta', 'Jakarta'), (28, 'cgk', 'Jakarta')"""
_DICE = "CASE WHEN k = o THEN 1.0 WHEN length(k) < 2 OR length(o) < 2 THEN 0.0 ELSE 2.0 * len(list_filter(list_transform(range(1, length(k)), lambda i: substring(k, i, 2)), lambda g: list_contains(list_transform(range(1, length(o)), lambda i: substring(o, i, 2)), g))) / (length(k) + length(o) - 2) END"


@query(f"""
    WITH n AS (SELECT DISTINCT location_name AS name FROM geo_documents WHERE location_name IS NOT NULL), k AS (SELECT name, regexp_replace(regexp_replace(trim(lower(name)), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g') AS k FROM n),
    p(ord, o, canonical) AS (VALUES {_PLACES}), a(ord, o, canonical) AS (VALUES {_PLACE_ALIAS}), every_name AS (SELECT * FROM p UNION ALL SELECT * FROM a),
    direct AS (SELECT name, min_by(canonical, ord) AS c FROM k JOIN p ON k = o GROUP BY name), alias AS (SELECT name, min_by(canonical, ord) AS c FROM k JOIN a ON k = o GROUP BY name),
    fuzzy AS (SELECT name, min_by(canonical, ord) AS c FROM k, every_name WHERE {_DICE} >= 0.8 GROUP BY name)
    SELECT name, CASE WHEN name <> '' THEN coalesce(direct.c, alias.c, fuzzy.c, name) END AS canonical, CASE WHEN name = '' THEN NULL WHEN k = '' THEN 'as_is' WHEN direct.c IS NOT NULL THEN 'direct' WHEN alias.c IS NOT NULL THEN 'alias' WHEN fuzzy.c IS NOT NULL THEN 'fuzzy' ELSE 'as_is' END AS how
    FROM n JOIN k USING (name) LEFT JOIN direct USING (name) LEFT JOIN alias USING (name) LEFT JOIN fuzzy USING (name)""")
def place_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Every place name of the points in its canonical spelling."""
    names = table(spark, d, "geo_documents").where("location_name IS NOT NULL").select(F.col("location_name").alias("name")).distinct()
    return places.normalise(names, "name", places.known_places(spark)).select("name", "canonical", "how")


@query("SELECT 'paris' AS variation UNION ALL SELECT unnest(['par', 'the city of light', 'cdg', 'lutetia', 'the old town'])")
def place_variations(spark: SparkSession, d: str) -> DataFrame:
    """All keys of a place, one name having been added."""
    return places.variations(places.known_places(spark, [("Lutetia", "Paris", ["The Old Town"])]), "Paris")


@query(f"WITH x AS (SELECT DISTINCT regexp_replace(regexp_replace(trim(lower(location_name)), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g') AS k, 'quindo bay' AS o FROM geo_documents WHERE location_name IS NOT NULL) SELECT k, round(CAST({_DICE} AS DOUBLE), 6) AS likeness FROM x")
def place_dice(spark: SparkSession, d: str) -> DataFrame:
    """How much each place name is like one name."""
    keys = table(spark, d, "geo_documents").where("location_name IS NOT NULL").select(places.place_key(F.col("location_name")).alias("k")).distinct()
    return keys.select("k", F.round(places.dice(F.col("k"), F.lit("quindo bay")), 6).alias("likeness"))


@query(f"""
    WITH p AS (SELECT geo_id, location_name, {_d('lat', 'lng', *_AT)} AS km FROM (SELECT DISTINCT * FROM ({_GEO})) WHERE {_OK}), n AS (SELECT * FROM p WHERE km <= 3000 ORDER BY km, geo_id LIMIT 60)
    SELECT geo_id, round(0.7 * CAST({_score_sql(['location_name'], ['bay'])} AS DOUBLE) + 0.3 * (1 - km / 3000), 6) AS score FROM n ORDER BY score DESC, km, geo_id LIMIT 20""")
def text_geo_combined(spark: SparkSession, d: str) -> DataFrame:
    """Text search within a circle."""
    near = geosearch.by_radius(_points(spark, d).distinct(), "geo_id", "lat", "lng", _AT, 3000)
    return geosearch.text_and_geo(near, "geo_id", ["location_name"], "bay", 20).select("geo_id", "score")


@query(f"""
    WITH c AS (SELECT center.lat AS clat, center.lng AS clng FROM geo_buckets WHERE bucket_no = (SELECT min(bucket_no) FROM geo_buckets)),
    p AS (SELECT geo_id, location_name, {_d('lat', 'lng', 'clat', 'clng')} AS km FROM (SELECT DISTINCT * FROM ({_GEO})), c WHERE {_OK} AND location_name LIKE '%a%'), n AS (SELECT * FROM p WHERE km <= 25 ORDER BY km, geo_id LIMIT 300)
    SELECT geo_id, round(0.7 * CAST({_score_sql(['location_name'], ['bay'])} AS DOUBLE) + 0.3 * (1 - km / 25), 6) AS score FROM n ORDER BY score DESC, km, geo_id LIMIT 100""")
def search_place_model(spark: SparkSession, d: str) -> DataFrame:
    """A search by a filter model that holds a place, a pattern and keys that are no columns."""
    at = table(spark, d, "geo_buckets").orderBy("bucket_no").first().center
    e = Engine(spark, CATALOG)
    e.register("geo_documents", _points(spark, d).distinct())
    model = {"andFilter": {"lat": at.lat, "lng": at.lng}, "likeFilter": {"location_name": "a"}, "page": 2, "order": "ASC"}
    return e.geo_documents.search("bay", limit=100, filters=model).select("geo_id", "score")

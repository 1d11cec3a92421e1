"""Tokenisers as Column expressions.

A tokeniser turns a text column into an array of (pos, term): pos counts all
words of the text, also those left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.stem import stem_words
from quernel.session import spread

# The stop words left out by default.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "the", "this", "but", "they", "have",
]
#: Separators between words: white space (any script's) and punctuation.
SEPARATORS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\p{P}]+"


def words_of(text: Column, case_sensitive: bool = False) -> Column:
    """The words of a text in order, as an array; empty for null and empty texts."""
    folded = text if case_sensitive else F.lower(text)
    return F.coalesce(F.filter(F.split(folded, SEPARATORS), lambda w: w != ""), F.array().cast("array<string>"))


def simple_tokens(text: Column, min_length: int = 3, stop_words: list[str] | None = None, case_sensitive: bool = False) -> Column:
    """Words of at least ``min_length`` characters that hold a letter or digit and are no stop words."""
    stop = STOP_WORDS if stop_words is None else stop_words
    placed = F.transform(words_of(text, case_sensitive), lambda w, i: F.struct(i.alias("pos"), w.alias("term")))
    keep = lambda t: (F.length(t["term"]) >= min_length) & t["term"].rlike(r"[\p{L}\p{N}]") & ~t["term"].isin(stop or [""])
    return F.filter(placed, keep)


def stemmed_tokens(text: Column, min_length: int = 3, stop_words: list[str] | None = None) -> Column:
    """Simple tokens by their stems."""
    tokens = simple_tokens(text, min_length, stop_words)
    return F.zip_with(tokens, stem_words(F.transform(tokens, lambda t: t["term"])), lambda t, s: F.struct(t["pos"].alias("pos"), s.alias("term")))


def ngram_tokens(text: Column, n: int = 3, min_length: int = 3) -> Column:
    """All runs of ``n`` characters of each word; shorter words whole if long enough. No stop words."""
    placed = F.transform(words_of(text), lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    pieces = lambda t: F.when(F.length(t["word"]) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t["word"]) - n + 1, F.lit(1))), lambda k: F.struct(t["pos"].alias("pos"), F.substring(t["word"], k, F.lit(n)).alias("term")))).when(F.length(t["word"]) >= min_length, F.array(F.struct(t["pos"].alias("pos"), t["word"].alias("term")))).otherwise(F.array().cast("array<struct<pos:int,term:string>>"))
    return F.flatten(F.transform(placed, pieces))


def tokens_of(text: Column, kind: str = "simple", min_length: int = 3) -> Column:
    """Tokens by the tokeniser's name; unknown names are simple."""
    if kind == "stemming":
        return stemmed_tokens(text, min_length)
    if kind == "ngram":
        return ngram_tokens(text, 3, min_length)
    return simple_tokens(text, min_length)


def merged_positions(df: DataFrame, key: list[str], fields: list[str], kind: str = "simple") -> DataFrame:
    """Key, field_ord, field, term and the sorted positions of every (field, term) of each row; only text fields count."""
    texts = [f for f in fields if dict(df.dtypes).get(f) == "string"]
    if not texts:
        raise ValueError("no text field")
    parts = F.array(*[F.struct(F.lit(i).alias("field_ord"), F.lit(f).alias("field"), tokens_of(F.col(f), kind).alias("tokens")) for i, f in enumerate(texts)])
    rows = spread(df.select(*key, *[t for t in texts if t not in key])).select(*key, F.inline(parts)).select(*key, "field_ord", "field", F.inline("tokens"))
    return rows.groupBy(*key, "field_ord", "field", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def unique_terms(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, lambda t: t["term"]))


def pair_proximity(tokens: Column, first: str, second: str) -> Column:
    """1 for terms side by side, .8 within 3 words, .5 within 10, .2 within 50, else .1; 0 if one is missing."""
    at = lambda term: F.transform(F.filter(tokens, lambda t: t["term"] == term), lambda t: t["pos"])
    gap = F.array_min(F.flatten(F.transform(at(first), lambda a: F.transform(at(second), lambda b: F.abs(a - b)))))
    return F.when(gap.isNull(), 0.0).when(gap == 1, 1.0).when(gap <= 3, 0.8).when(gap <= 10, 0.5).when(gap <= 50, 0.2).otherwise(0.1)

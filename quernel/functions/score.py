"""Scores, highlights and snippets as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weights of the combined score.
TFIDF_WEIGHT, BOOST_WEIGHT, PROXIMITY_WEIGHT = 1.0, 1.0, 0.5


def query_terms(query: str) -> list[str]:
    """The query in lower case, split at white space."""
    return query.lower().split()


def quoted(terms: list[str]) -> str:
    """An alternation that matches the terms literally, as whole words (ASCII letters, digits, underscore)."""
    return r"(?-U)\b(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in terms) + r")\b"


def simple_score(fields: list[Column], query: str) -> Column:
    """1 for each field and term it contains, and .5 more as a whole word, divided by fields times terms; 0 to 1.5.

    Null and empty fields count nowhere; 0 without terms or fields.
    """
    terms = query_terms(query)
    if not terms or not fields:
        return F.lit(0.0)
    hit = lambda f, t: F.when(F.lower(f).contains(t), F.when(F.lower(f).rlike(quoted([t])), 1.5).otherwise(1.0)).otherwise(0.0)
    total = reduce(lambda a, b: a + b, [F.when(F.coalesce(f, F.lit("")) != "", hit(f, t)).otherwise(0.0) for f in fields for t in terms])
    counted = reduce(lambda a, b: a + b, [F.when(F.coalesce(f, F.lit("")) != "", len(terms)).otherwise(0) for f in fields])
    return F.when(counted > 0, total / counted).otherwise(0.0)


def highlight(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Whole-word hits of the terms, in any case, between two tags."""
    if not terms:
        return text
    safe = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, F.lit("(?i)" + quoted(terms)), F.lit(f"{safe(before)}$1{safe(after)}"))


def snippet(text: Column, terms: list[str], size: int = 150, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The surroundings of the first hit, cut at blanks, with dots where text is left out, highlighted; the start if there is no hit; '' for null."""
    near = (size - 20) // 2
    hits = [F.nullif(F.instr(F.lower(text), t.lower()), F.lit(0)) for t in terms]
    at = F.least(*hits) - 1 if len(hits) > 1 else hits[0] - 1 if hits else F.lit(None).cast("int")
    length = F.length(text)
    start, end = F.greatest(at - near, F.lit(0)), F.least(at + near, length)
    head = F.substring(text, F.lit(1), start + 1)
    last_blank = F.length(head) - F.instr(F.reverse(head), " ")
    start = F.when((start > 0) & F.contains(head, F.lit(" ")), last_blank + 1).otherwise(start)
    next_blank = F.instr(F.substring(text, end + 1, length), " ")
    end = F.when((end < length) & (next_blank > 0), end + next_blank - 1).otherwise(end)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < length, "...").otherwise(""))
    plain = F.concat(F.substring(text, 1, size), F.when(length > size, "...").otherwise(""))
    return F.coalesce(F.when(at.isNull(), plain).otherwise(highlight(cut, terms, before, after)), F.lit(""))


def tf_idf(tf: Column, df: Column, total: Column) -> Column:
    return tf * F.log((total + 1) / (df + 1))


def bm25(tf: Column, df: Column, total: Column, length: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    idf = F.log((total - df + 0.5) / (df + 0.5) + 1)
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean_length))


def freshness(when: Column, now: Column) -> Column:
    """exp(-age in days / 30); 0 without a date."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(when.cast("timestamp"))) / 86_400_000_000
    return F.coalesce(F.exp(-days / 30), F.lit(0.0))


def combined(tfidf: Column, boost: Column, proximity: Column) -> Column:
    return F.least(F.lit(1.0), (tfidf * TFIDF_WEIGHT + boost * BOOST_WEIGHT + proximity * PROXIMITY_WEIGHT) / 10)


def proximity(positions: Column, terms: int) -> Column:
    """How close several terms stand. ``positions`` has an array of positions per found term, the first found term first.

    For each position of that term the farthest of the nearest positions of the
    others; the least of these as 1 (0), .9 (to 2), .7 (5), .5 (10), .3 (20), else .1.
    0 for a single term or if a term is missing.
    """
    others = F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0)))
    nearest = lambda p: F.coalesce(F.array_max(F.transform(others, lambda o: F.array_min(F.transform(o, lambda q: F.abs(q - p))))), F.lit(0))
    span = F.array_min(F.transform(F.element_at(positions, 1), nearest))
    score = F.when(span == 0, 1.0).when(span <= 2, 0.9).when(span <= 5, 0.7).when(span <= 10, 0.5).when(span <= 20, 0.3).otherwise(0.1)
    return F.when(F.lit(terms <= 1) | (F.size(positions) < terms), 0.0).otherwise(score)

"""Records that are the same but for their writing, collapsed in two steps.

Byte-identical rows collapse first, with counts, in a plain hash aggregate.
Only the distinct survivors are parsed and brought into a canonical writing,
and the second grouping is on that full text, summing the counts.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal, InvalidOperation
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernel.operators.skew import salted_join
from quernel.session import cut, ship

_NOISE = regex.compile(r"[^\p{L}\p{N}]+")
_TOKEN = re.compile(r"""[{}\[\]:,]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|“[^”]*”|„[^“”]*[“”]|‘[^’]*’|«[^»]*»|`[^`]*`|[^{}\[\]:,;\s"'“”„‘’«»`]+|["'“”„‘’«»`]""", re.S)
_QUOTES = frozenset("\"'“”„‘’«»`")
_PLAIN, _POINT, _NUMBER = re.compile(r"-?(?:0|[1-9]\d*)"), re.compile(r"-?(?:0|[1-9]\d*)\.\d+"), re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
#: Closing semicolons and invisible characters stand between tokens.
_SKIPPED = re.compile(r"[​﻿]")


def letters_and_digits(text: str) -> str:
    """The letters and digits of a text, in lower case and composed."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.lower() if text.isalnum() else _NOISE.sub("", text).lower()


@lru_cache(maxsize=100_000)
def _word(word: str) -> str:
    """A bare word: a number, true, false, null or text."""
    if _PLAIN.fullmatch(word):
        return "n" + (word if word != "-0" else "0")
    if _POINT.fullmatch(word):
        short = word.rstrip("0").rstrip(".")
        return "n" + (short if short != "-0" else "0")
    low = word.lower()
    if low in ("true", "false"):
        return "b" + low
    if low in ("null", "none"):
        return "z"
    if _NUMBER.fullmatch(word):
        try:
            number = Decimal(word).normalize()
            return "n" + (f"{number:f}" if abs(number.adjusted()) < 400 else str(number)) if number else "n0"
        except InvalidOperation:
            pass
    return "t" + letters_and_digits(word)


@lru_cache(maxsize=100_000)
def _quoted(token: str) -> str:
    if len(token) < 2:
        raise ValueError("open quote")
    inner = token[1:-1]
    return "t" + letters_and_digits(re.sub(r"\\(.)", r"\1", inner, flags=re.S) if "\\" in inner else inner)


def canonical(text: str | None) -> str | None:
    """The content of a loosely written object in one writing.

    Fields are sorted at every level; names and text values keep letters and
    digits in lower case; numbers keep their value (sign and decimal point),
    true, false and null their kind whatever their case; lists keep their
    order. Any quotes, none, trailing commas and closing semicolons are read.
    Null stays null. Text that is no such object becomes its letters, digits,
    signs and points, marked as unread, so it never equals a read one.
    """
    if text is None:
        return None
    try:
        found = _parse(_TOKEN.findall(_SKIPPED.sub("", text)))
    except ValueError:
        return "?" + regex.sub(r"[^\p{L}\p{N}.+-]+", "", unicodedata.normalize("NFC", text)).lower()
    return found


def _parse(tokens: list[str]) -> str:
    """Iterative, so depth is bounded by memory only. A frame is its opening mark, the name waiting for a value, the parts, and whether a value just came."""
    top: list = ["top", None, [], False]
    stack = [top]
    bare = ""
    for token in [*tokens, ""]:
        first = token[:1]
        word = token and first not in _MARKS and first not in _QUOTES
        if word:
            bare = f"{bare} {token}" if bare else token
            continue
        if bare:
            _put(top, _word(bare))
            bare = ""
        if not token:
            break
        if first in _QUOTES:
            _put(top, _quoted(token))
        elif token in "{[":
            top = [token, None, [], False]
            stack.append(top)
        elif token == ":":
            if top[0] != "{" or top[1] is not None or top[3] is not True or top[2][-1][0] in "{[":
                raise ValueError("no name")
            top[1], top[3] = top[2].pop()[1:], False
        elif token == ",":
            if top[0] == "{" and (top[1] is not None or top[3] is True):
                raise ValueError("no value")
            top[3] = False
        else:
            if len(stack) < 2 or "{[".index(top[0]) != "}]".index(token) or top[1] is not None or (top[0] == "{" and top[3] is True):
                raise ValueError("unbalanced")
            done = "{" + ",".join(sorted(top[2])) + "}" if token == "}" else "[" + ",".join(top[2]) + "]"
            stack.pop()
            top = stack[-1]
            _put(top, done)
    if len(stack) != 1 or len(top[2]) != 1:
        raise ValueError("not one object")
    return top[2][0]


def _put(top: list, value: str) -> None:
    """A value joins its frame; in an object one without a name is a name to be (3 is True), else a finished field (3 is 1)."""
    if top[3]:
        raise ValueError("no comma")
    if top[1] is not None:
        value, top[1], top[3] = f"{top[1]}:{value}", None, 1
    else:
        top[3] = True if top[0] != "[" else 1
    top[2].append(value)


_MARKS = frozenset("{}[]:,")


@F.pandas_udf(StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


@F.pandas_udf(StringType())
def plain_code(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else letters_and_digits(t))


def collapse(df: DataFrame, record: str, exact: list[str], code: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Sets of records that differ in writing only.

    ``exact`` columns must be equal, ``code`` must have the same letters and
    digits, ``content`` the same content (``canonical``). Nulls equal only
    nulls. Returns (sets, members): sets has the exact columns, the canonical
    code and content, ``kept_id`` (the least record id) and ``copies``; members
    has ``record_id`` and ``kept_id`` of every row, also of single ones.
    Repeated rows count as copies. Rows with a null record id count as copies
    but have no member row. Other columns are ignored; empty input, no rows.
    """
    ship(df.sparkSession)
    raw = [*exact, code, content]
    named = {c: f"_c{i}" for i, c in enumerate(raw)}
    rows = df.select(*[F.col(c).alias(a) for c, a in named.items()], F.col(record).alias("record_id"))
    exact_, (code_, content_) = [named[c] for c in exact], [named[code], named[content]]
    distinct = rows.groupBy(*named.values()).agg(F.min("record_id").alias("least"), F.count(F.lit(1)).alias("n"))
    odd = F.when(F.col(code_).rlike(r"[^\x00-\x7F]"), F.col(code_))
    plain = F.coalesce(plain_code(odd), F.regexp_replace(F.lower(F.col(code_)), r"[^\p{L}\p{N}]+", ""))
    survivors = cut(distinct.select(_digest(list(named.values())).alias("_raw"), *exact_, plain.alias("_code"), canonical_text(content_).alias("_content"), "least", "n"))
    group = [*exact_, "_code", "_content"]
    sets = survivors.groupBy(*group).agg(F.min("least").alias("kept_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("writings"))
    kept = cut(sets.select(_digest(group).alias("_set"), "kept_id", "writings"))
    raw_kept = cut(salted_join(survivors.select(_digest(group).alias("_set"), "_raw", "n"), kept, ["_set"], "writings", "_raw").select("_raw", "n", "kept_id"))
    found = rows.where(F.col("record_id").isNotNull()).select(_digest(list(named.values())).alias("_raw"), "record_id")
    members = salted_join(found, raw_kept, ["_raw"], "n", "record_id").select("record_id", "kept_id")
    back = {a: c for c, a in named.items() if c in exact} | {"_code": code, "_content": content}
    return sets.drop("writings").withColumnsRenamed(back), members


def _digest(columns: list[str]) -> Column:
    """128 bits that stand for the columns where rows find their group again; lengths keep the parts apart, nulls have none."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*parts)))

"""A simplified Porter stemmer as Column expressions.

Each step is one ``transform`` over the array of words, so its input is a bound
variable and five steps don't multiply the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of steps 2 to 4, in order of trial, with what replaces them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_CVC = r"[^aeiou][aeiou][^aeiouwxy]$"


def measure(word: Column) -> Column:
    """How often a vowel is followed by another letter."""
    return F.regexp_count(word, F.lit("[aeiou][^aeiou]"))


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _first_match(word: Column, cases: list[tuple[Column, Column]]) -> Column:
    (test, then), *rest = cases
    out = F.when(test, then)
    for test, then in rest:
        out = out.when(test, then)
    return out.otherwise(word)


def _fixed(stem: Column) -> Column:
    """at, bl and iz get an e; a double consonant loses one; a short stem gets an e."""
    doubled = (F.length(stem) > 1) & (F.right(stem, F.lit(1)) == F.substring(stem, F.length(stem) - 1, F.lit(1))) & ~stem.rlike("[aeiou]$")
    return F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(doubled, _cut(stem, 1)).when((measure(stem) == 1) & stem.rlike(_CVC), F.concat(stem, F.lit("e"))).otherwise(stem)


def _step1(w: Column) -> Column:
    return _first_match(w, [
        (w.endswith("sses"), _cut(w, 2)),
        (w.endswith("ies"), F.concat(_cut(w, 3), F.lit("i"))),
        (w.endswith("ss"), w),
        (w.endswith("s"), _cut(w, 1)),
        (w.endswith("eed") & (measure(_cut(w, 3)) > 0), _cut(w, 1)),
        (w.endswith("ed") & _cut(w, 2).rlike("[aeiou]"), _fixed(_cut(w, 2))),
        (w.endswith("ing") & _cut(w, 3).rlike("[aeiou]"), _fixed(_cut(w, 3))),
    ])


def _replaced(w: Column, table: dict[str, str]) -> Column:
    return _first_match(w, [(w.endswith(s) & (measure(_cut(w, len(s))) > 0), F.concat(_cut(w, len(s)), F.lit(r))) for s, r in table.items()])


def _step4(w: Column) -> Column:
    return _first_match(w, [(w.endswith(s) & (measure(_cut(w, len(s))) > 1), _cut(w, len(s))) for s in STEP4])


def _step5(w: Column) -> Column:
    m = measure(_cut(w, 1))
    silent = w.endswith("e") & ((m > 1) | ((m == 1) & ~_cut(w, 1).rlike(_CVC)))
    return _first_match(w, [(silent, _cut(w, 1)), (w.endswith("ll") & (measure(w) > 1), _cut(w, 1))])


def stem_words(words: Column) -> Column:
    """The stems of an array of lower-case words."""
    for step in (_step1, lambda w: _replaced(w, STEP2), lambda w: _replaced(w, STEP3), _step4, _step5):
        words = F.transform(words, step)
    return words


def stem(word: Column) -> Column:
    """The stem of one lower-case word."""
    return F.element_at(stem_words(F.array(word)), 1)

"""The prose of a document and figures on how demanding it is.

What is prose is told by structure alone: fences, list and heading marks,
blocks of markup, brackets and dashes in pairs, and lines in which fewer than
two thirds of the tokens are words. No phrase is looked for, no length is
limited; what is written between emphasis marks stays.
"""

from __future__ import annotations

import re

import numpy as np

_FENCE = re.compile(r"\s*(```|~~~)")
_BLOCKS = re.compile(r"<(pre|code|script|style|table|ul|ol|h[1-6])\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAKS = re.compile(r"</?(?:p|div|br|section|article|blockquote|td|tr|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|</?[A-Za-z][^<>]*>", re.S)
_SPAN = re.compile(r"`[^`]*`")
_LINK = re.compile(r"!?\[[^\[\]]*\]\([^()\s]*\)|(?:https?://|www\.)[^\s()<>]*[^\s()<>.,;:!?]")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);")
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_DASHES = re.compile(r"(?<=\s)[-–—]\s(?:[^.!?;–—\n-]*\s)?[-–—](?=[\s.,;:!?])|—[^—.!?;\n]+—")
_LIST = re.compile(r"\s*(?:[-*•‣+–]|\(?\d+[.)]|\(?[a-zA-Z][.)])\s+\S")
_HEAD = re.compile(r"\s*(?:#{1,6}\s|={3,}|-{3,}|\*{3,})")
#: A token that is written as a word, with marks around it, and one in capitals.
_PLAIN = re.compile(r"""["'“”‘’„«*_]*[^\W\d_]+(?:['’—–-][^\W\d_]+)*["'”’»*_.,;:!?…]*""")
_CAPITALS = re.compile(r"[A-Z]{2,}[.,;:]?")
#: A sign, digit or joint that words don't have, or one letter four times in a row.
_CODED = re.compile(r"[\d{}=|$<>\\@#]|::|->|[^\W\d_]_[^\W\d_]|\w[:(]\w|\w\(|[^\W_]{2}\.[^\W_]|[^\W_]/|[a-z][A-Z]|([^\W\d_])\1{3}|[\"']:")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PART = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[,;:]")
_DOTTED = re.compile(r"(?:[A-Za-z]\.){2,}")
_VOWELS = re.compile(r"[aeiouyáéíóúàèìòùäöüâêîôû]+")
_QUOTES = "\"'“”‘’„«»()[]*_"
#: English abbreviations whose point ends no sentence.
_SHORT = frozenset(("approx.", "art.", "ca.", "cf.", "dr.", "e.g.", "fig.", "figs.", "i.e.", "jr.", "mr.", "mrs.", "ms.", "no.", "nos.", "p.", "pp.", "prof.", "sec.", "sr.", "st.", "viz.", "vol.", "vs."))
#: English endings of abstract nouns.
_ABSTRACT = ("tion", "sion", "ment", "ness", "ity", "ance", "ence", "ism", "ship", "ization", "isation", "ology")
#: English words that open a clause: subordinators, relatives and conjunctive adverbs.
_LINKERS = frozenset(("accordingly", "after", "although", "as", "because", "before", "consequently", "even", "furthermore", "hence", "how", "however", "if", "insofar", "irrespective", "lest", "moreover", "nevertheless", "nonetheless", "notwithstanding", "once", "provided", "since", "so", "than", "that", "therefore", "though", "thus", "till", "unless", "until", "what", "when", "whenever", "where", "whereas", "wherever", "whether", "which", "while", "who", "whom", "whose", "why"))
#: English prepositions.
_PREPOSITIONS = frozenset(("about", "above", "across", "against", "along", "among", "around", "at", "behind", "below", "beneath", "beside", "between", "beyond", "by", "concerning", "despite", "during", "for", "from", "in", "inside", "into", "near", "of", "off", "on", "onto", "out", "outside", "over", "per", "regarding", "through", "throughout", "to", "toward", "towards", "under", "upon", "via", "with", "within", "without"))
#: Marks within a sentence.
_MARKS = ",;:"
#: Kinds of a word, added up.
_ABSTRACT_WORD, _LINKER, _PREPOSITION, _MARK = 1, 2, 4, 8
#: How a token can close a sentence: not, always, only before a capital.
_OPEN, _CLOSED, _PERHAPS = 0, 1, 2
#: Tokens a worker remembers before it starts anew.
_REMEMBERED = 200_000


def syllables(word: str) -> int:
    groups = len(_VOWELS.findall(word))
    if word.endswith("e") and not word.endswith(("le", "ee")) and groups > 1:
        groups -= 1
    return max(1, groups)


class _Tokens(dict):
    """What a token between blanks is, remembered: (is written as a word, in capitals, coded, closes, starts like a sentence, its words and marks by number)."""

    def __init__(self) -> None:
        super().__init__()
        self.numbers: dict[str, int] = {}
        self.figures: list[tuple[int, int, int]] = []

    def number(self, word: str) -> int:
        found = self.numbers.get(word)
        if found is None:
            kind = (len(word) > 5 and word.endswith(_ABSTRACT)) * _ABSTRACT_WORD | (word in _LINKERS) * _LINKER | (word in _PREPOSITIONS) * _PREPOSITION | (word in _MARKS) * _MARK
            found = self.numbers[word] = len(self.figures)
            self.figures.append((len(word), syllables(word), kind))
        return found

    def __missing__(self, token: str) -> tuple:
        bare = token.strip(_QUOTES)
        dotted = _DOTTED.fullmatch(bare) is not None
        coded = not dotted and _CODED.search(token) is not None
        closes = _OPEN
        if bare.endswith((".", "!", "?", "…")):
            closes = _OPEN if bare.lower() in _SHORT else _PERHAPS if dotted else _CLOSED
        elif bare.endswith(";"):
            closes = _PERHAPS
        starts = token[:1].isupper() or token[:1].isdigit() or token[:1] in "\"“'"
        words = () if coded or dotted else tuple(self.number(w) for w in _PART.findall(token.lower()))
        found = self[token] = (_PLAIN.fullmatch(token) is not None or dotted, _CAPITALS.fullmatch(token) is not None, coded, closes, starts, words)
        return found


_tokens = _Tokens()


def _is_code(line: list[tuple]) -> bool:
    """Whether fewer than two thirds of a line's tokens are words; words in capitals count only where most are."""
    plain, capitals = sum(t[0] for t in line), sum(t[1] for t in line)
    return 3 * (plain - capitals if capitals < plain else plain) < 2 * len(line)


def _read(line: str) -> list[tuple]:
    return [_tokens[t] for t in line.split()]


def _cut(line: list[tuple], found: list[list[int]]) -> None:
    """The sentences of a run of tokens, coded ones left out but for the end of a sentence they may be; one word is none."""
    held: list[int] = []
    last = len(line) - 1
    for k, (_, _, _, closes, _, words) in enumerate(line):
        held += words
        if closes and (closes == _CLOSED or k == last or line[k + 1][4]) or k == last:
            if len(held) >= 2 and sum(_tokens.figures[n][2] != _MARK for n in held) >= 2:
                found.append(held)
            held = []


def _prose(text: str) -> list[list[int]]:
    """The sentences of the prose as the numbers of their words and of the marks within them."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text:
        text = _TAG.sub(" ", _BREAKS.sub("\n\n", _BLOCKS.sub("\n\n", text)))
    blocks: list[list[str]] = []
    block: list[str] = []
    fenced = False
    for line in [*text.split("\n"), ""]:
        if _FENCE.match(line):
            fenced = not fenced
            line = ""
        elif fenced or _LIST.match(line) or _HEAD.match(line):
            line = ""
        line = line.strip()
        if line:
            block.append(line)
        elif block:
            blocks.append(block)
            block = []
    found: list[list[int]] = []
    for block in blocks:
        joined = "\n".join(block)
        if "`" in joined:
            joined = _SPAN.sub(" ", joined)
        if "&" in joined:
            joined = _ENTITY.sub(" ", joined)
        if "](" in joined or "://" in joined or "www." in joined:
            joined = _LINK.sub(" ", joined)
        lines = [(line, read) for line in joined.split("\n") if (read := _read(line)) and not _is_code(read)]
        joined = "\n".join(line for line, _ in lines)
        aside = joined
        while "(" in aside or "[" in aside:
            aside, changed = _BRACKETS.subn(" ", aside)
            if not changed:
                break
        if " - " in aside or "–" in aside or "—" in aside:
            aside = _DASHES.sub(" ", aside)
        reads = [read for _, read in lines] if aside == joined else map(_read, aside.split("\n"))
        reads = [read for read in reads if any(t[5] for t in read)]
        if not reads:
            continue
        closed = sum(read[-1][3] == _CLOSED for read in reads)
        if not closed and len(reads) == 1 and sum(len(t[5]) for t in reads[0]) <= 12:
            continue
        if len(reads) > 1 and sum(read[0][4] for read in reads) >= 0.8 * len(reads) and closed <= 0.2 * len(reads):
            for read in reads:
                _cut(read, found)
        else:
            _cut([t for read in reads for t in read], found)
    return found


def sentences(text: str) -> list[list[str]]:
    """The sentences of the prose as lists of words.

    Headings (one line of at most 12 words without a closing mark), lists,
    code, dumps, tables, links, asides in brackets or between dashes and markup
    are no prose; in a line of prose only the coded tokens go. Lines without a
    full stop are sentences of their own where a block is written one sentence
    a line, and parts of one where it is wrapped. One word is no sentence.
    """
    found = _prose(text)
    words = list(_tokens.numbers)
    return [[words[n] for n in s if _tokens.figures[n][2] != _MARK] for s in found]


FEATURES = (
    "words_mean", "words_median", "words_p90", "words_spread",
    "letters_mean", "letters_p90", "syllables_mean", "syllables_p90", "long_share", "many_syllables_share", "abstract_share", "variety",
    "clause_mean", "clause_p90", "clauses_mean", "clauses_p90", "linkers_share", "prepositions_share",
    "overlap_mean", "overlap_median", "overlap_p90", "school_years",
)


class _Runs:
    """Values of several texts one after another; ``sizes`` are the numbers of each text's, none of them 0."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.sizes = values.astype(float), np.asarray(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._sorted: np.ndarray | None = None

    def mean(self) -> np.ndarray:
        return np.add.reduceat(self.values, self.starts) / self.sizes

    def spread(self) -> np.ndarray:
        return np.sqrt(np.add.reduceat((self.values - np.repeat(self.mean(), self.sizes)) ** 2, self.starts) / self.sizes)

    def at(self, share: float) -> np.ndarray:
        """The percentile of each text, between neighbours in proportion."""
        if self._sorted is None:
            self._sorted = self.values[np.lexsort((self.values, np.repeat(np.arange(len(self.sizes)), self.sizes)))]
        place = share * (self.sizes - 1)
        low = place.astype(int)
        a, b = self._sorted[self.starts + low], self._sorted[self.starts + np.minimum(low + 1, self.sizes - 1)]
        return a + (b - a) * (place - low)


def _totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(sizes) - sizes)


def _variety(words: list[int]) -> float:
    """The mean share of different words in windows of 50, the last one ending at the last word."""
    last = max(0, len(words) - 50)
    starts = [*range(0, last, 50), last]
    return sum(len(set(words[i : i + 50])) for i in starts) / (len(starts) * min(50, len(words)))


def features_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Length, vocabulary, syntax and cohesion of the prose of many texts: which of them have any, and a row of ``FEATURES`` for each of those.

    All figures but variety and overlap are taken over one flat array of the
    batch's words, so that numpy is called per batch and not per text.
    """
    if len(_tokens) > _REMEMBERED:
        _tokens.clear()
        _tokens.__init__()
    has = np.zeros(len(texts), bool)
    sizes: list[int] = []
    per_text: list[int] = []
    flat: list[int] = []
    variety: list[float] = []
    overlap: list[float] = []
    overlaps: list[int] = []
    marks = {_tokens.number(m) for m in _MARKS}
    for k, text in enumerate(texts):
        found = _prose(text) if text else []
        if not found:
            continue
        has[k] = True
        sets = [set(s) - marks for s in found]
        shared = [len(a & b) / min(len(a), len(b)) for a, b in zip(sets, sets[1:])] or [0.0]
        whole = [n for s in found for n in s]
        flat += whole
        sizes += map(len, found)
        per_text.append(len(found))
        variety.append(_variety([n for n in whole if n not in marks]))
        overlap += shared
        overlaps.append(len(shared))
    if not per_text:
        return has, np.empty((0, len(FEATURES)))
    letters, beats, kind = np.array(_tokens.figures, np.int64)[np.array(flat)].T
    sizes, word = np.array(sizes), kind != _MARK
    counts = _totals(word.astype(np.int64), sizes)
    lengths = _Runs(counts, per_text)
    words = _totals(counts, lengths.sizes)
    of = lambda values: _Runs(values[word], words)
    # a clause starts at a sentence's start, at a mark and at a linker; those without words are none
    opens = ~word | (kind & _LINKER > 0)
    opens[np.cumsum(sizes) - sizes] = True
    starts = np.flatnonzero(opens)
    spans = np.add.reduceat(word.astype(np.int64), starts)
    clauses = np.bincount(np.searchsorted(np.cumsum(sizes), starts[spans > 0], side="right"), minlength=len(sizes))
    clause = _Runs(spans[spans > 0], _totals(clauses, lengths.sizes))
    per_sentence, links = _Runs(clauses, per_text), _Runs(np.array(overlap), overlaps)
    length, beat, sound = lengths.mean(), of(beats), of(letters)
    return has, np.column_stack([
        length, lengths.at(0.5), lengths.at(0.9), lengths.spread(),
        sound.mean(), sound.at(0.9), beat.mean(), beat.at(0.9), of(letters >= 8).mean(), of(beats >= 4).mean(), of(kind & _ABSTRACT_WORD > 0).mean(), variety,
        clause.mean(), clause.at(0.9), per_sentence.mean(), per_sentence.at(0.9), of(kind & _LINKER > 0).mean(), of(kind & _PREPOSITION > 0).mean(),
        links.mean(), links.at(0.5), links.at(0.9), 0.39 * length + 11.8 * beat.mean() - 15.59,
    ])


def features(text: str | None) -> tuple[float, ...] | None:
    """The figures of one text; null where there is no prose."""
    has, found = features_of([text])
    return tuple(found[0].tolist()) if has[0] else None

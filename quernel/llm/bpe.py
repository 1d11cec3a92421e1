"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse.

The encoding of a prefix is a path of tokens; the last token at each byte is
the only one that ends there and is compatible with the token before it, i.e.
the merges of the two tokens' bytes give just these two. So the transducer
keeps one back pointer per byte. A token is final once every position from
which later input can go on leads back to it; these positions lie within the
longest token's length (``Transducer.lookahead``, computed from the merge
list), hence whatever all of them share is emitted and forgotten.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import regex

#: Pattern that splits text before merging. White space is the Unicode property, which excludes the control separators 1C to 1F.
_SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Bytes between two emissions in a long piece.
_STRIDE = 4096
#: Words remembered, and the longest one remembered, per worker.
_WORDS, _WORD_LENGTH = 300_000, 48


class Transducer:
    """Encoder and decoder for a file of ranks (base64 token and rank a line); a token's rank is its id and its merge priority."""

    def __init__(self, path: str, ranks: bytes | None = None) -> None:
        """From a file of ranks, or from its content."""
        if ranks is None:
            ranks = Path(path).read_bytes()
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.tokens = {v: k for k, v in self.ids.items()}
        self.lookahead = max(map(len, self.ids))
        self.tails = {t[k:] for t in self.ids for k in range(len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merges(self, piece: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first; the definition, for short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        pair = left, right
        if (known := self.fits.get(pair)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[pair] = self.merges(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that comes in chunks, in memory bounded by the stride and the lookahead."""
        held, last = b"", [-1]
        for chunk in chunks:
            for first in range(0, len(chunk), _STRIDE):
                held += chunk[first : first + _STRIDE]
                for end in range(len(last), len(held) + 1):
                    last.append(self._last(held, end, last))
                done, _ = self._common(range(max(0, len(held) + 1 - self.lookahead), len(held) + 1), last)
                if done:
                    yield from self._path(done, last)
                    held = held[done:]
                    last = [last[done], *last[done + 1 :]]
        yield from self._path(len(held), last)

    def _last(self, held: bytes, end: int, last: list[int]) -> int:
        """The token that ends at ``end``. Position 0 bears the token emitted before, or -1 at the start."""
        found = []
        for size in range(1, min(self.lookahead, end) + 1):
            part = held[end - size : end]
            if part not in self.tails:
                break
            if part in self.ids:
                found.append(self.ids[part])
        for token in reversed(found):
            before = last[end - len(self.tokens[token])]
            if before < 0 or self.compatible(before, token):
                return token
        raise ValueError("the ranks don't hold every byte")

    def _common(self, ends: Iterable[int], last: list[int]) -> tuple[int, int]:
        """The position that the paths from all ``ends`` share."""
        at = sorted(set(ends))
        while len(at) > 1:
            top = at.pop()
            back = top - len(self.tokens[last[top]]) if top else 0
            if back <= 0:
                return 0, 0
            if back not in at:
                at.append(back)
                at.sort()
        return at[0], len(at)

    def _path(self, end: int, last: list[int]) -> list[int]:
        path = []
        while end > 0:
            path.append(last[end])
            end -= len(self.tokens[last[end]])
        return path[::-1]

    def word(self, piece: str) -> tuple[int, ...]:
        if (known := self.words.get(piece)) is None:
            data = piece.encode("utf-8", "surrogatepass")
            known = (self.ids[data],) if data in self.ids else tuple(self.stream([data]))
            if len(piece) <= _WORD_LENGTH:
                if len(self.words) >= _WORDS:
                    self.words.clear()
                self.words[piece] = known
        return known

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; text that spells a special token is ordinary text."""
        out: list[int] = []
        for piece in PIECES.finditer(text):
            out.extend(self.word(piece.group()))
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text, token by token; bytes wait until they complete a character, broken ones become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for token in ids:
            if part := machine.decode(self.tokens[token]):
                yield part
        if part := machine.decode(b"", True):
            yield part


_held: dict[str, Transducer] = {}


def transducer(path: str, ranks: Callable[[], bytes] | None = None) -> Transducer:
    """The transducer of a file, once per worker; from its content where the worker has no such file. The last two are kept."""
    if path not in _held:
        while len(_held) > 1:
            del _held[next(iter(_held))]
        _held[path] = Transducer(path, ranks() if ranks and not Path(path).exists() else None)
    return _held[path]

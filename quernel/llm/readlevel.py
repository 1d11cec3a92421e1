"""Reading level by gradient-boosted regression trees.

The trees learn the years of school of graded texts from ``prose.features_of``.
Each source is predicted by trees that saw none of its texts; these held-out
predictions are calibrated by a rising function and give each source's error.
Graded texts that name no source get the one whose texts are most like them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.prose import features_of
from quernel.session import ship, spread

#: Years of school that the levels of the graded texts stand for: below 7, 7 to 12, and 13 or more, by their middles.
YEARS = {"basic": 4.0, "plain": 9.0, "advanced": 17.0}
_WORDS = re.compile(r"\w+")
#: From this on a text is advanced.
ADVANCED = 13.0
#: Graded texts used for training at most (by lowest hash of the id beyond that).
MAX_SAMPLES = 20_000
#: Relative difference below which two splits are equally good; of those the one between the values furthest apart is taken.
TIE = 1e-9
#: Texts of known source at most, by lowest hash of their key, from which the sources of graded texts without one are told.
MAX_STYLED = 2_000


@dataclass
class Trees:
    """Boosted regression trees for squared error, on shares of the rows and features drawn by a fixed seed."""

    rounds: int = 150
    depth: int = 3
    rate: float = 0.1
    least: int = 3
    base: float = 0.0
    grown: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Trees:
        draw = np.random.default_rng(seed)
        self.base, self.grown = float(y.mean()), []
        fitted = np.full(len(y), self.base)
        for _ in range(self.rounds):
            rows = np.sort(draw.permutation(len(y))[: max(2 * self.least, int(0.7 * len(y)))])
            columns = np.sort(draw.permutation(x.shape[1])[: max(1, round(0.75 * x.shape[1]))])
            tree = self._grow(x[rows], (y - fitted)[rows], columns, self.depth)
            self.grown.append(tree)
            fitted += self.rate * self._read(tree, x)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, columns: np.ndarray, depth: int) -> tuple:
        """All splits of all drawn columns at once: k rows to the left, those with equal values kept together."""
        split = None
        if depth and len(y) >= 2 * self.least:
            order = np.argsort(x[:, columns], axis=0, kind="stable")
            v, s = np.take_along_axis(x[:, columns], order, 0), np.cumsum(y[order], axis=0)
            k = np.arange(self.least, len(y) - self.least + 1)[:, None]
            below, above, range_ = v[self.least - 1 : len(y) - self.least], v[self.least : len(y) - self.least + 1], v[-1] - v[0]
            left, total = s[self.least - 1 : len(y) - self.least], s[-1]
            gain = np.where(below < above, left**2 / k + (total - left) ** 2 / (len(y) - k) - total**2 / len(y), -1.0)
            if gain.max() > 1e-12:
                gap = np.where(gain >= gain.max() * (1 - TIE), (above - below) / np.where(range_ > 0, range_, 1.0), -1.0)
                row, column = np.unravel_index(int(np.argmax(gap)), gap.shape)
                split = int(columns[column]), float((below[row, column] + above[row, column]) / 2)
        if split is None:
            return (float(y.mean()) if len(y) else 0.0,)
        left = x[:, split[0]] <= split[1]
        return *split, self._grow(x[left], y[left], columns, depth - 1), self._grow(x[~left], y[~left], columns, depth - 1)

    def _read(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._read(tree[2], x[left]), self._read(tree[3], x[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._read(t, x) for t in self.grown), np.zeros(len(x)))


def rising(x: np.ndarray, y: np.ndarray, bins: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """A rising function of x for y: means of ``bins`` shares of the rows, neighbours that fall pooled; as knots for interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, min(bins, len(order))):
        pools.append([float(x[part].mean()), float(y[part].mean()), len(part)])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            a, b = pools[-2], pools.pop()
            pools[-1] = [*((a[k] * a[2] + b[k] * b[2]) / (a[2] + b[2]) for k in (0, 1)), a[2] + b[2]]
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


@dataclass
class Model:
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]
    error: dict[str, float]

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.predict(x), *self.knots)


def _folds(years: np.ndarray, sources: np.ndarray, folds: int) -> np.ndarray:
    """Whole sources dealt to folds, the largest first to the smallest fold; a single source in parts, by level."""
    fold, names = np.zeros(len(years), int), sorted(set(sources), key=lambda s: (-int((sources == s).sum()), s))
    if len(names) > 1:
        held = np.zeros(min(folds, len(names)), int)
        for name in names:
            mine, to = sources == name, int(np.argmin(held))
            fold[mine] = to
            held[to] += mine.sum()
        return fold
    for level in set(years):
        mine = np.flatnonzero(years == level)
        fold[mine] = np.arange(len(mine)) % folds
    return fold


def train(x: np.ndarray, years: np.ndarray, sources: np.ndarray, folds: int = 10) -> Model:
    """Fit on all, calibrate on held-out predictions; ``error`` has the mean absolute held-out error of each source.

    No source is in two folds (up to ``folds`` sources have one each); only
    where there is a single source are its texts dealt within levels.
    """
    fold = _folds(years, sources, folds)
    held = np.zeros(len(years))
    for k in range(fold.max() + 1):
        out = fold == k
        held[out] = Trees().fit(x[~out], years[~out]).predict(x[out]) if not out.all() else years.mean()
    knots = rising(held, years)
    off = np.abs(np.interp(held, *knots) - years)
    return Model(Trees().fit(x, years), knots, {str(s): float(off[sources == s].mean()) for s in sorted(set(sources))})


def alike(texts: list[str], known: list[tuple[str, str]]) -> list[str]:
    """For each text the source whose (source, text) pairs use its words most, by smoothed word shares of each source."""
    counts: dict[str, Counter] = {}
    for source, text in known:
        counts.setdefault(source, Counter()).update(_WORDS.findall(text.lower()))
    size, vocabulary = {s: sum(c.values()) for s, c in counts.items()}, len(set().union(*counts.values())) + 1 if counts else 1
    found = []
    for text in texts:
        words = Counter(_WORDS.findall(text.lower()))
        score = {s: sum(n * math.log((c[w] + 0.5) / (size[s] + 0.5 * vocabulary)) for w, n in words.items()) for s, c in counts.items()}
        found.append(max(sorted(score), key=score.get) if score else "all")
    return found


def train_on(samples: DataFrame, key: str, text: str, level: str, source: Column | None = None, limit: int = MAX_SAMPLES, styled: DataFrame | None = None, styles: int = MAX_STYLED) -> Model:
    """A model of graded texts. Rows of unknown level or without prose are left out; at most ``limit`` texts come to the driver.

    ``source`` is the samples' own; without it, ``styled`` (key, text, source)
    tells which source each sample is most like, from at most ``styles`` rows
    by lowest hash of their key. It serves to draw the folds only.
    """
    graded = samples.where(F.col(level).isin(list(YEARS)) & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(level).alias("g"), (F.lit(None) if source is None else source).cast("string").alias("s"))
    rows = graded.orderBy(F.xxhash64("k"), "k", "t").limit(limit).collect()
    has, x = features_of([r.t for r in rows])
    if not has.any():
        raise ValueError("no graded text with prose")
    rows = [r for r, h in zip(rows, has) if h]
    sources = [str(r.s) for r in rows]
    if source is None and styled is not None:
        named = styled.toDF("k", "t", "s").where(F.col("t").isNotNull() & F.col("s").isNotNull())
        sources = alike([r.t for r in rows], [(r.s, r.t) for r in named.orderBy(F.xxhash64("k"), "k", "t").limit(styles).collect()])
    return train(x, np.array([YEARS[r.g] for r in rows]), np.array(sources, object))


def reading_level(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``key`` and ``grade`` (years of school) of every row; null for null and empty texts and texts without prose.

    A narrow pass over whole texts. Repeated rows come out as they are; other
    columns are ignored.
    """
    ship(df.sparkSession)

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            has, found = features_of(page["_text"].tolist())
            grades = pd.array([None] * len(page), "Float64")
            if has.any():
                grades[has] = model.grade(found)
            yield pd.DataFrame({"_key": page["_key"], "grade": grades})

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))).mapInPandas(run, f"_key {kind}, grade double").withColumnRenamed("_key", key)

"""Mixing sources to target weights by soft membership.

A record belongs to a domain (source) with a probability: 1 where its source is
known, else the posterior of a classifier fitted to the labelled records. Each
record has a rate, the expected number of its copies, between 0 and its cap.
Projected gradient steps on the least squares between expected domain totals
and targets fit the rates, those of labelled records first and then, against
what these leave open, those of records without a source. A step needs only the
totals of all domains, so a record's rate is a function of the short history of
residuals and of its own membership, and nothing per record leaves the
executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.bpe import PIECES
from quernel.llm.tokens import VOCABULARY, with_token_counts
from quernel.session import cut, ship, spread

#: Sources at most; they come to the driver.
SOURCES = 1_000
#: Hashed features of the classifier; its table has domains * FEATURES counts.
FEATURES = 4096
#: Labelled records the classifier is fitted to (expected number, drawn by hash), and of these held out to calibrate it.
LABELLED, HELD_OUT = 20_000, 4_000
#: Powers of the likelihood tried in calibration; hashed words are not independent, so posteriors by their product are too sure.
POWERS = tuple(2.0**-k for k in range(12))
#: Steps at most, and the change of all totals, relative to the largest target, at which fitting ends.
STEPS, CLOSE = 100, 1e-4


def _hashed(text: str | None) -> np.ndarray:
    words = [zlib.crc32(p.group().strip().lower().encode("utf-8", "surrogatepass")) % FEATURES for p in PIECES.finditer(text or "")]
    return np.bincount(words, minlength=FEATURES) if words else np.zeros(FEATURES, int)


def _sampled(df: DataFrame, text: str, domain: str, domains: list[str], limit: int) -> DataFrame:
    """About ``limit`` labelled rows by the hash of text and domain, all where there are fewer; ``_held`` marks those held out."""
    labelled = df.where(F.col(domain).isin(domains) & F.col(text).isNotNull())
    share = min(1.0, limit / max(1, labelled.count()))
    place = F.pmod(F.xxhash64(text, domain), F.lit(1 << 30))
    kept = labelled.select(F.col(text).alias("_text"), F.col(domain).alias("_domain"), place.alias("_place")).where(F.col("_place") < int(share * (1 << 30)))
    return kept.select("_text", "_domain", (F.pmod(F.hash("_place"), F.lit(max(2, limit // HELD_OUT))) == 0).alias("_held"))


def classifier(df: DataFrame, text: str, domain: str, domains: list[str], limit: int = LABELLED) -> np.ndarray:
    """Log priors and log likelihoods (domains x (FEATURES + 1)) from about ``limit`` labelled rows.

    The likelihoods carry the power that makes held-out labelled rows likeliest.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {d: np.zeros(FEATURES + 1, np.int64) for d in domains}
        for batch in batches:
            for t, d, held in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not held:
                    counts[d][:FEATURES] += _hashed(t)
                    counts[d][FEATURES] += 1
        for d, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["d", "f", "n"])

    rows = spread(_sampled(df, text, domain, domains, limit))
    counts = np.zeros((len(domains), FEATURES + 1))
    for d, f, n in rows.mapInArrow(run, "d string, f int, n long").groupBy("d", "f").agg(F.sum("n")).collect():
        counts[domains.index(d), f] = n
    likely = np.log(counts[:, :FEATURES] + 0.5) - np.log((counts[:, :FEATURES] + 0.5).sum(1, keepdims=True))
    prior = np.log((counts[:, FEATURES:] + 0.5) / (counts[:, FEATURES:] + 0.5).sum())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros(len(POWERS))
        for batch in batches:
            for t, d, held in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held:
                    score = likely @ _hashed(t)
                    for k, power in enumerate(POWERS):
                        at = prior[:, 0] + power * score
                        gain[k] += at[domains.index(d)] - at.max() - np.log(np.exp(at - at.max()).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(POWERS)), pa.int32()), pa.array(gain)], ["k", "gain"])

    gains = sorted(((-r[1], r[0]) for r in rows.mapInArrow(judge, "k int, gain double").groupBy("k").agg(F.sum("gain")).collect()))
    return np.hstack([likely * (POWERS[gains[0][1]] if gains else 1.0), prior])


def memberships(df: DataFrame, text: str, table: np.ndarray, name: str = "posterior") -> DataFrame:
    """``df`` without ``text`` and with the posterior of every domain; an empty text has the prior."""
    ship(df.sparkSession)
    kept = df.drop(text, name)
    at = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(at).to_pylist():
                seen = _hashed(t)
                score = table[:, FEATURES] + table[:, :FEATURES] @ seen
                share = np.exp(score - score.max())
                found.append((share / share.sum()).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names[:at], name])

    schema = kept.withColumn(name, F.array(F.lit(0.0))).schema
    return df.select(*kept.columns, F.col(text).alias("_text")).mapInArrow(run, schema)


@dataclass
class Mixture:
    """records: the records in the mixture with n_tokens, posterior, cap, rate, copies. shares: a row per source."""

    records: DataFrame
    shares: DataFrame


def _rate(history: list[list[float]]) -> Column:
    """The rate that the steps so far give a record of this membership and cap."""
    if not history:
        return F.lit(0.0)
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in history])
    pull = lambda g: F.aggregate(F.zip_with("posterior", g, lambda p, e: p * e), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(steps, F.lit(0.0), lambda r, g: F.least(F.greatest(r - pull(g), F.lit(0.0)), F.col("cap")))


def _totals(rows: DataFrame, weight: Column, domains: int) -> np.ndarray:
    """The expected total of ``weight`` in every domain."""
    each = [F.coalesce(F.sum(F.element_at("posterior", k + 1) * weight), F.lit(0.0)) for k in range(domains)]
    return np.array(rows.agg(*each).first(), float)


def _fit(rows: DataFrame, target: np.ndarray) -> tuple[list[list[float]], np.ndarray, bool]:
    """Residuals of the steps, totals reached, and whether they settled. A step of each record is its membership's mean of the relative residuals, which never grows the error."""
    size, reached = _totals(rows, F.col("n"), len(target)), np.zeros(len(target))
    history: list[list[float]] = []
    for _ in range(STEPS):
        history.append(np.divide(reached - target, size, out=np.zeros(len(target)), where=size > 0).tolist())
        before, reached = reached, _totals(rows, F.col("n") * _rate(history), len(target))
        if np.abs(reached - before).max() <= CLOSE * max(1.0, target.max()):
            return history, reached, True
    return history, reached, False


def mixture(docs: DataFrame, key: str, text: str, source: str, weights: DataFrame, adopt: bool = True, vocabulary: str = VOCABULARY) -> Mixture:
    """One mixture of the sources in ``weights`` (source, weight, max_repeats).

    A source's target is its share of all weights times the size (tokens) of
    all records of these sources; no record is repeated more than max_repeats
    times, so a source that is too small falls short of its target (``capped``).
    With ``adopt`` records of null source fill up what the known ones leave
    open, once at most, by the classifier's posteriors; they don't change
    targets. Several rows of one source add their weights and take the largest
    max_repeats; null or negative weights and caps count as 0; null sources are
    no targets. Records of other sources take no part. Null and empty texts
    have size 0. Repeated rows are records of their own. The sources must fit
    the driver: more than ``SOURCES`` raise.

    shares: source, available, max_repeats, target_share, target, reached (by
    records of that source), capped, adopted (expected size of records of null
    source), steps, settled (the totals stopped moving before ``STEPS``),
    copied and share (of the whole numbers of copies drawn).
    """
    known = weights.where(F.col("source").isNotNull()).groupBy("source").agg(F.greatest(F.coalesce(F.sum("weight"), F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("m")).limit(SOURCES + 1).collect()
    if len(known) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    known = sorted(known, key=lambda r: r[0])
    spark = docs.sparkSession
    ship(spark)
    domains, share = [r[0] for r in known], np.array([r[1] for r in known], float)
    share = share / share.sum() if share.sum() else share
    listed = F.col("_source").isin(domains)
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text")).where(listed | (F.col("_source").isNull() & F.lit(adopt and bool(domains))))
    sized = with_token_counts(rows.withColumn("_words", F.when(F.col("_source").isNull(), F.col("_text"))), "_text", vocabulary)
    hard = F.transform(F.array(*[F.lit(d) for d in domains]), lambda d: (d == F.col("_source")).cast("double")) if domains else F.array().cast("array<double>")
    caps = F.element_at(F.create_map(*[F.lit(x) for d, _, m in known for x in (d, float(m))]), F.col("_source")) if domains else F.lit(0.0)
    if adopt and domains:
        sized = memberships(sized, "_words", classifier(docs, text, source, domains), "_soft").withColumn("posterior", F.when(listed, hard).otherwise(F.col("_soft"))).drop("_soft")
    else:
        sized = sized.drop("_words").withColumn("posterior", hard)
    held = cut(sized.withColumn("cap", F.when(listed, caps).otherwise(1.0)))
    classes = cut(held.groupBy("posterior", "cap", F.col("_source").isNotNull().alias("_known")).agg(F.sum("n_tokens").alias("n")))
    of_known, of_others = classes.where("_known"), classes.where("NOT _known")
    size = _totals(of_known, F.col("n"), len(domains)) if domains else np.zeros(0)
    target = share * size.sum()
    first, reached, settled = _fit(of_known, target) if domains else ([], size, True)
    short = np.maximum(target - reached, 0.0)
    then, adopted, settled_too = _fit(of_others, short) if adopt and short.any() else ([], np.zeros(len(domains)), True)
    luck = F.pmod(F.xxhash64("_key", F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    records = held.withColumn("rate", F.when(F.col("_source").isNotNull(), _rate(first)).otherwise(_rate(then)))
    records = records.withColumn("copies", (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
    copied = _totals(records, F.col("n_tokens") * F.col("copies"), len(domains)) if domains else size
    schema = "source string, available long, max_repeats long, target_share double, target double, reached double, capped boolean, adopted double, steps int, settled boolean, copied long, share double"
    margin = 10 * CLOSE * max(1.0, float(target.max(initial=0.0)))
    tell = [(d, int(round(size[k])), int(known[k][2]), float(share[k]), float(target[k]), float(reached[k]), bool(reached[k] < target[k] - min(margin, target[k] / 100)), float(adopted[k]), len(first) + len(then), settled and settled_too, int(round(copied[k])), float(copied[k] / copied.sum()) if copied.sum() else 0.0) for k, d in enumerate(domains)]
    return Mixture(records.withColumnsRenamed({"_key": key, "_source": source}), spark.createDataFrame(tell, schema))

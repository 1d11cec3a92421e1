"""Per-key selection and running records against plain Python, also where keys are cut into many pieces."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quernel.operators import selection
from quernel.operators.selection import exact_quantiles, running_records
from quernel.operators.skew import salted_join


def _rows(n: int, seed: int) -> list[tuple]:
    draw = random.Random(seed)
    kinds = [lambda: draw.randint(0, 10), lambda: draw.randint(-(10**9), 10**9), lambda: int(draw.paretovariate(0.3)) % 10**15]
    return [(draw.choice(["hot", "hot", "hot", "a", "b", None]), draw.choice(kinds)(), i) for i in range(n)]


@pytest.mark.parametrize("small", [50, 10_000])
def test_quantiles(spark, small):
    rows = _rows(3000, 1) + [("hot", None, -1)]
    found = exact_quantiles(spark.createDataFrame(rows, "k string, v long, prob_ long"), ["k"], "v", [0.0, 0.25, 0.5, 0.99, 1.0], bins=32, small=small)
    held = defaultdict(list)
    for k, v, _ in rows:
        if v is not None:
            held[k].append(v)
    wanted = {(k, p): (sorted(v)[max(1, math.ceil(p * len(v))) - 1], len(v)) for k, v in held.items() for p in (0.0, 0.25, 0.5, 0.99, 1.0)}
    assert {(r.k, r.prob): (r.value, r.n) for r in found.collect()} == wanted


def test_quantiles_of_doubles_decimals_and_nothing(spark):
    rows = spark.range(2000).select(F.lit("x").alias("k"), (F.rand(3) * F.pow(F.lit(10.0), (F.rand(4) * 30).cast("int"))).alias("v"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    values = sorted(r.v for r in rows.collect())
    assert exact_quantiles(rows, ["k"], "v", [0.5], bins=16, small=10).first().value == values[999]
    tens = rows.select("k", F.round(F.col("v") % 1000, 2).cast("decimal(10,2)").alias("v"))
    values = sorted(r.v for r in tens.collect())
    assert exact_quantiles(tens, ["k"], "v", [0.9], bins=16, small=10).first().value == values[1799]
    assert exact_quantiles(rows.limit(0), ["k"], "v", [0.5]).count() == 0


def test_quantiles_of_any_doubles(spark):
    draw = random.Random(8)
    values = [math.inf, -math.inf, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] * 3 + [draw.choice([-1, 1]) * draw.random() * 10.0 ** draw.randint(-307, 307) for _ in range(3000)] + [1.0 + k * 2**-52 for k in range(500)]
    rows = spark.createDataFrame([("x", v) for v in values] + [("x", float("nan")), ("y", float("nan"))], "k string, v double")
    probs = [0.0, 0.001, 0.3, 0.5, 0.55, 0.999, 1.0]
    found = {(r.k, r.prob): (r.value, r.n) for r in exact_quantiles(rows, ["k"], "v", probs, bins=1024, small=5).collect()}
    assert found == {("x", p): (sorted(values)[max(1, math.ceil(p * len(values))) - 1], len(values)) for p in probs}


def test_what_does_not_resolve_raises(spark, monkeypatch):
    monkeypatch.setattr(selection, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        exact_quantiles(spark.range(5000).select(F.lit("x").alias("k"), "id"), ["k"], "id", [0.5], bins=4, small=10)


def _records(rows: list[tuple]) -> set[tuple]:
    out, most = set(), {}
    for k, t, i, v in sorted((r for r in set(rows) if None not in r), key=lambda r: (r[1], r[2])):
        if k in most and v > most[k]:
            out.add((k, t, i, v))
        most[k] = max(v, most.get(k, v))
    return out


@pytest.mark.parametrize("block", [7, 40, 10_000])
@pytest.mark.parametrize("shape", ["mixed", "one_instant", "rising"])
def test_running_records(spark, block, shape):
    draw = random.Random(5)
    if shape == "mixed":
        rows = [(draw.choice(["hot", "hot", "b", None]), draw.randint(0, 60), i, draw.choice([None, draw.randint(0, 40), draw.randint(0, 10**6)])) for i in range(400)]
    elif shape == "one_instant":
        rows = [("hot", 5, i, draw.randint(0, 10**6)) for i in range(300)]
    else:
        rows = [("hot", i, i, i) for i in range(300)]
    rows += rows[::5]
    found = running_records(spark.createDataFrame(rows, "k string, t long, i long, v long"), ["k"], ["t", "i"], "v", block, bins=16)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == _records(rows)


def test_running_records_of_nothing(spark):
    assert running_records(spark.createDataFrame([], "k string, t long, v long"), ["k"], ["t"], "v").count() == 0


def test_salted_join(spark):
    left = spark.createDataFrame([(None if i % 7 == 0 else "hot" if i % 2 else "b", i) for i in range(400)], "k string, i long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least"))
    found = salted_join(left, right, ["k"], "n", "i", limit=20)
    assert found.columns == ["k", "i", "least"] and found.count() == 400 and found.select("i").distinct().count() == 400
    assert {(r.k, r.least) for r in found.collect()} == {(r.k, r.least) for r in right.collect()}

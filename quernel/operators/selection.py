"""Per-key results over very uneven keys.

``refine`` is the one primitive: a histogram of mergeable counts per key,
refined again and again where a caller still needs more detail. Rows never
gather by key; each round is a scan, a lookup of broadcast intervals and a
map-side combined count. The intervals refined in a round are at most (number
of rows) / (rows an interval must have to be refined); the callers keep that
below what fits ``BROADCAST_BYTES`` at the measured size of the keys, so the
broadcast is bounded at every input size.

On it stand ``exact_quantiles`` (values at exact ranks per key) and
``running_records`` (rows above all earlier rows of their key).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import cut

#: Bytes of the intervals under refinement in one round, over all keys together, and of an interval's columns without its keys' texts.
BROADCAST_BYTES, INTERVAL_BYTES = 32 << 20, 320
#: Rounds in which whole numbers, decimals and doubles of any range resolve (38 digits of a decimal in bins of 2 take the most).
MAX_ROUNDS = 160


def _octaves(v: Column) -> Column:
    """A number that never falls as the double ``v`` rises, with the same distance between octaves of any size; infinities lie one beyond the last."""
    size = F.least(F.log2(F.abs(v)), F.lit(1025.0)) + 1100.0
    return F.when(v == 0, 0.0).when(v > 0, size).otherwise(-size)


def _bin(value: Column, lo: Column, hi: Column, bins: int, floating: bool = False) -> Column:
    """0 .. bins-1, never falling as ``value`` rises; lo is in the first, hi in the last, and they differ where lo < hi.

    Doubles that span many octaves are divided by octaves first, so no range
    takes more than a dozen rounds of 1,024 bins.
    """
    far = F.coalesce(F.try_subtract(value, lo).cast("double"), value.cast("double") - lo.cast("double"))
    width = F.coalesce(F.try_subtract(hi, lo).cast("double"), hi.cast("double") - lo.cast("double"))
    share = F.when(width > 0, F.greatest(F.lit(0.0), far / width)).otherwise(0.0)
    if floating:
        v, a, b = (x.cast("double") for x in (value, lo, hi))
        far_apart = (F.signum(a) != F.signum(b)) | (F.abs(F.log2(F.abs(a)) - F.log2(F.abs(b))) > 20)
        share = F.when(far_apart & (a != b), (_octaves(v) - _octaves(a)) / (_octaves(b) - _octaves(a))).otherwise(share)
    return F.least(F.lit(bins - 1), F.floor(F.when(value >= hi, 1.0).otherwise(share) * bins)).cast("int")


def _interval_limit(sizes: DataFrame, keys: list[str], n: str) -> tuple[int, int]:
    """How many rows there are, and how many intervals may be broadcast, by the mean size of the rows' keys; ``sizes`` has each key with its ``n`` rows."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys], F.lit(0))
    total, texts = sizes.agg(F.sum(n), F.sum(size * F.col(n))).first()
    return total or 0, max(1, int(BROADCAST_BYTES / (INTERVAL_BYTES + 2 * (texts or 0) / max(1, total or 0))))


def _same(names: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names])


def _located(df: DataFrame, keys: list[str], order: list[str], levels: list[DataFrame], bins: int, first: int = 1) -> DataFrame:
    """``df`` with the bin of each row at each level from ``first`` on (``_p1`` ...), null below a leaf."""
    floating = [dict(df.dtypes)[c] in ("double", "float") for c in order]
    for depth, level in enumerate(levels, first):
        on = keys + [f"_p{k}" for k in range(1, depth)]
        found = df.alias("d").join(F.broadcast(level.select(*on, "_axis", *[f"_{e}{j}" for j in range(len(order)) for e in ("lo", "hi")])).alias("s"), _same(on, "d", "s"), "left")
        position = F.lit(None).cast("int")
        for j, column in enumerate(order):
            position = F.when(F.col("s._axis") == j, _bin(F.col(f"d.{column}"), F.col(f"s._lo{j}"), F.col(f"s._hi{j}"), bins, floating[j])).otherwise(position)
        df = found.select("d.*", position.alias(f"_p{depth}"))
    return df


def refine(df: DataFrame, keys: list[str], order: list[str], needs: Callable[[DataFrame], DataFrame], bins: int, narrow: bool = False) -> tuple[list[DataFrame], list[DataFrame]]:
    """Histograms of ``order`` per key, refined where ``needs`` asks for it.

    ``needs`` gets the cells of a round (keys, path ``_p1..``, ``_n`` rows,
    ``_lo{j}``/``_hi{j}`` of each order column, ``_below`` rows of the key
    before the cell) and returns those to refine. Returns the cells of every
    round and the refined intervals of every round. The order columns must
    hold no nulls; ties of the first are refined along the next. With
    ``narrow`` the rows of the intervals under refinement are written after
    each round with their place, and the next round reads only these: right
    where few intervals are wanted, as for quantiles.
    """
    ends = [f(c).alias(f"_{e}{j}") for j, c in enumerate(order) for e, f in (("lo", F.min), ("hi", F.max))]
    axis = reduce(lambda rest, j: F.when(F.col(f"_lo{j}") < F.col(f"_hi{j}"), j).otherwise(rest), reversed(range(len(order))), F.lit(None).cast("int"))
    cells = [cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *ends).withColumn("_below", F.lit(0).cast("long")))]
    levels: list[DataFrame] = []
    placed = df
    while True:
        level = cut(needs(cells[-1]).withColumn("_axis", axis).where(F.col("_axis").isNotNull()))
        if level.isEmpty():
            break
        if len(levels) == MAX_ROUNDS:
            raise RuntimeError(f"intervals that don't resolve in {MAX_ROUNDS} rounds")
        levels.append(level)
        path = [f"_p{k}" for k in range(1, len(levels) + 1)]
        if narrow and len(levels) > 1:
            on = [*keys, *path[:-1]]
            placed = cut(placed.alias("d").join(F.broadcast(level.select(*on)).alias("s"), _same(on, "d", "s"), "left_semi"))
        placed = _located(placed, keys, order, [level], bins, len(levels))
        found = placed.where(F.col(path[-1]).isNotNull()).groupBy(*keys, *path).agg(F.count(F.lit(1)).alias("_n"), *ends)
        parent = level.select(*keys, *path[:-1], F.col("_below").alias("_start"))
        before = Window.partitionBy(*keys, *path[:-1]).orderBy(path[-1]).rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        found = found.alias("c").join(F.broadcast(parent).alias("u"), _same([*keys, *path[:-1]], "c", "u")).select("c.*", (F.col("u._start") + F.col("c._before")).alias("_below")).drop("_before")
        cells.append(cut(found))
    return cells, levels


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = 1024, small: int = 20_000) -> DataFrame:
    """The exact value at rank ceil(prob * n) (at least 1) of ``value`` per key.

    Columns: keys, prob, value, n. Keys with up to ``small`` rows (more where
    so many larger ones would exceed the broadcast) are ranked by a window,
    all others by iterative refinement of histograms, so no task ever holds the
    values of a hot key. Null and NaN values are no measurements and are left out; a
    null key is a key of its own; an empty input gives no rows. Ties are exact:
    equal values share ranks and the value is the same whichever row bears it.
    Columns other than the keys and ``value`` are ignored.
    """
    rows = df.select(*[F.col(k) for k in keys], F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    if dict(rows.dtypes)["_v"] in ("double", "float"):
        rows = rows.where(~F.isnan("_v"))
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")))
    total, allowed = _interval_limit(sizes, keys, "_total")
    limit = max(small, total * max(1, len(probs)) // allowed)
    wanted = F.array(*[F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_total"))).cast("long") for p in probs])

    ranked = rows.alias("d").join(sizes.where(F.col("_total") > limit).alias("s"), _same(keys, "d", "s"), "left_anti")
    own = Window.partitionBy(*keys)
    ranked = ranked.select("*", F.row_number().over(own.orderBy("_v")).cast("long").alias("_rank"), F.count(F.lit(1)).over(own).alias("_total"))
    few = ranked.select(*keys, "_v", "_total", F.posexplode(wanted).alias("_k", "_target"), "_rank").where(F.col("_rank") == F.col("_target"))

    hot = F.broadcast(sizes.where(F.col("_total") > limit))
    inside = rows.alias("d").join(hot.alias("s"), _same(keys, "d", "s")).select("d.*")
    sized = lambda cells: cells.alias("c").join(hot.alias("s"), _same(keys, "c", "s")).select("c.*", "s._total").withColumn("_targets", F.filter(wanted, lambda t: (t > F.col("_below")) & (t <= F.col("_below") + F.col("_n"))))
    cells, _ = refine(inside, keys, ["_v"], lambda c: sized(c).where(F.size("_targets") > 0).drop("_total", "_targets"), bins, narrow=True)
    done = [sized(c).where((F.col("_lo0") == F.col("_hi0")) & (F.size("_targets") > 0)).select(*keys, F.col("_lo0").alias("_v"), "_total", F.posexplode(wanted).alias("_k", "_target"), "_targets").where(F.array_contains("_targets", F.col("_target"))) for c in cells]
    every = reduce(lambda a, b: a.unionByName(b), [x.select(*keys, "_v", "_total", "_k") for x in [few, *done]])
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_k") + 1)
    return every.select(*keys, prob.alias("prob"), F.col("_v").alias("value"), F.col("_total").alias("n"))


def running_records(df: DataFrame, keys: list[str], order: list[str], value: str, block_rows: int = 8192, bins: int = 256) -> DataFrame:
    """Rows whose ``value`` is strictly above that of all earlier rows of their key.

    Earlier is by the ``order`` columns. The first row of a key is no record.
    All columns of ``df`` come back. Rows with a null key are of no group, rows
    with a null in order or value are no measurement: both are left out. Repeats
    of a row (same key, order and value) cannot exceed their first copy and so
    never come out twice. Ties in value are no records.

    A key with many rows is cut along its order into leaves of at most about
    ``block_rows`` rows by selection (``refine``). The maximum of each leaf is a
    mergeable count-like figure; its running maximum is carried into the next
    leaf, rows not above it go before any shuffle, and what is left is compared
    within its leaf. So no task sees a whole key.
    """
    need = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, *order, value]])
    rows = df.where(need)
    limits: list[int] = []

    def crowded(cells: DataFrame) -> DataFrame:
        if not limits:
            total, allowed = _interval_limit(cells, keys, "_n")
            limits.append(max(block_rows, total // allowed))
        return cells.where(F.col("_n") > limits[0])

    _, levels = refine(rows.select(*keys, *order), keys, order, crowded, bins)
    path = [f"_p{k}" for k in range(1, len(levels) + 1)]
    placed = _located(rows, keys, order, levels, bins).fillna(-1, path) if path else rows
    before = Window.partitionBy(*keys).orderBy(*path) if path else None
    if path:
        tops = placed.where(F.col(path[0]) >= 0).groupBy(*keys, *path).agg(F.max(value).alias("_top"))
        carry = tops.select(*keys, *path, F.max("_top").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
        carry = cut(carry.where(F.col("_carry").isNotNull()))
        live = placed.join(carry, [*keys, *path], "left")
        live = live.where(F.col("_carry").isNull() | (F.col(value) > F.col("_carry")))
    else:
        live = placed.withColumn("_carry", F.lit(None).cast(rows.schema[value].dataType))
    earlier = Window.partitionBy(*keys, *path).orderBy(*order, value).rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("_most", F.greatest(F.max(value).over(earlier), F.col("_carry")))
    return live.where(F.col(value) > F.col("_most")).select(*df.columns)

"""Exact order statistics that never sort a table in one task.

For quantiles, a double is placed on a signed logarithmic scale that is cut into 2**bits buckets per e-fold.
Buckets are monotone in the value and nest: finer ones refine coarser ones. A quantile is found by counting
buckets first and ordering the values of one bucket afterwards. Running totals take a tree over the bits of a
double: totals before a node, plus those inside it, down to the single values.

Equal values are summed before they move, so a hot value is one row, and a hot key is spread over
all its buckets.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgewise.session import stored

_LOWEST_LOG = 746  # below the logarithm of the smallest positive double
_FINEST = 28  # at most 34 million doubles share such a bucket
_LEVELS, _LEVEL_BITS = 4, 16  # of the tree that running totals are taken in; together the bits of a double
WINDOW_ROWS = 1 << _LEVEL_BITS
_QUANTILE_STEPS = (12, 20, 28)  # coarse counts compress well before the shuffle; finer ones if needed
_LARGE_BUCKET = 5_000_000  # rows
BUCKET = "_bucket"


def bucket_of(v: Column, bits: int) -> Column:
    """Place of a double on the bucket scale; monotone in the value, NULL for NULL."""
    size = F.least(F.abs(v), F.lit(sys.float_info.max))
    step = F.floor(F.ln(size) * float(1 << _FINEST)) + F.lit(_LOWEST_LOG << _FINEST)
    finest = F.when(v > 0, step).when(v < 0, -step).when(v == 0, F.lit(0).cast("bigint"))
    return F.shiftright(finest, _FINEST - bits)


def _earlier(name: str, window) -> Column:
    """Sum over the rows before this one."""
    return F.coalesce(F.sum(name).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def image_of(v: Column) -> Column:
    """A bigint in the order of the double, one for each: its sign, exponent and 52 fraction bits. NULL for NULL.

    Powers of two are exact, so the fraction is. Both zeros are 0, values below the least normal one are counted in its 2**52 steps.
    """
    size = F.abs(v)
    guess = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    scaled = size / F.pow(F.lit(2.0), guess)  # the logarithm may round over a power of two
    exponent = guess + F.when(scaled < 1, -1).when(scaled >= 2, 1).otherwise(0)
    exponent = F.greatest(F.lit(-1022.0), exponent)
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)
    normal = F.shiftleft((exponent + 1023).cast("bigint"), 52) + fraction.cast("bigint")
    tiny = (size * float(2**537) * float(2**537)).cast("bigint")
    place = F.when(size == float("inf"), F.lit(0x7FF << 52)).when(size < sys.float_info.min, tiny).otherwise(normal)
    return F.when(v < 0, -place).when(v == 0, F.lit(0).cast("bigint")).otherwise(place)


def running_totals(df: DataFrame, keys: Sequence[str], value: str, totals: Sequence[str]) -> DataFrame:
    """Running sums over the distinct values of each key, in value order.

    One row per key and distinct value that is not NULL or NaN, with for each column ``t`` of ``totals``: its sum
    ``t`` at the value, ``t_before`` over smaller values and ``t_total`` over the key; and
    ``next_value``, the following distinct value.

    Values are filed in a tree of four levels by 16 bits each of their image. Each level has totals of its own, and what
    lies before a node is added down from its parent, so no window holds more than ``WINDOW_ROWS`` rows, however close
    or far apart the values are.
    """
    keys = list(keys)
    points = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, value)
        .agg(*[F.sum(t).alias(t) for t in totals])
        # the image never is NULL here; said outright, all uses of the points are one shuffle
        .withColumn(BUCKET, F.coalesce(image_of(F.col(value)), F.lit(0)))
        .withColumn("_low", F.col(value))
    )
    levels = [points]
    for _ in range(_LEVELS - 1):
        above = F.shiftright(BUCKET, _LEVEL_BITS).alias(BUCKET)
        sums = [F.sum(t).alias(t) for t in totals]
        levels.append(levels[-1].groupBy(*keys, above).agg(*sums, F.min("_low").alias("_low")))
    whole = Window.partitionBy(*keys)
    top = whole.orderBy(BUCKET)
    carried = [x for t in totals for x in (f"{t}_before", f"{t}_total")]
    placed = levels.pop().select(
        *keys,
        BUCKET,
        *[_earlier(t, top).alias(f"{t}_before") for t in totals],
        *[F.sum(t).over(whole).alias(f"{t}_total") for t in totals],
        F.lead("_low").over(top).alias("next_value"),
    )
    while levels:
        level = levels.pop()
        parent = F.shiftright(BUCKET, _LEVEL_BITS)
        siblings = Window.partitionBy(*keys, "_parent").orderBy(BUCKET)
        inside = level.withColumn("_parent", parent).select(
            "*", *[_earlier(t, siblings).alias(f"_v_{t}") for t in totals], F.lead("_low").over(siblings).alias("_v_next")
        )
        down = placed.select(*keys, F.col(BUCKET).alias("_parent"), *carried, F.col("next_value"))
        placed = inside.join(down, [*keys, "_parent"]).select(
            *keys,
            BUCKET,
            *([value, *totals] if not levels else []),
            *[(F.col(f"_v_{t}") + F.col(f"{t}_before")).alias(f"{t}_before") for t in totals],
            *[f"{t}_total" for t in totals],
            F.coalesce("_v_next", "next_value").alias("next_value"),
        )
    return placed.select(*keys, value, *totals, *carried, "next_value")


def weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """The shape the quantile steps work on: ``(keys, _v, _w)``, with ``_w`` copies of each row."""
    copies = F.col(weight) if weight else F.lit(1)
    v = F.col(value).cast("double")
    return df.select(*keys, F.when(~F.isnan(v), v).alias("_v"), copies.cast("bigint").alias("_w"))


def _bucketed(rows: DataFrame, bits: int) -> DataFrame:
    return rows.withColumn(BUCKET, bucket_of(F.col("_v"), bits))


def histogram(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key and coarse bucket; NULL values are counted under a NULL bucket."""
    return _bucketed(rows, _QUANTILE_STEPS[0]).groupBy(*keys, BUCKET).agg(F.sum("_w").alias("_w"))


def locate(counts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Which coarse buckets hold the wanted ranks, and at which place inside.

    A quantile lies between two neighbouring ranks; both are looked up. The result has two rows per
    key and probability.
    """
    keys = list(keys)
    ordered = Window.partitionBy(*keys).orderBy(BUCKET)
    placed = counts.dropna(subset=[*keys, BUCKET]).select(
        *keys,
        BUCKET,
        "_w",
        _earlier("_w", ordered).alias("_start"),
        F.sum("_w").over(Window.partitionBy(*keys)).alias("_n"),
    )
    ends = []
    for p in probs:
        at = (F.col("_n") - 1) * F.lit(float(p))
        for low, rank in ((True, F.floor(at)), (False, F.ceil(at))):
            ends.append(
                F.struct(
                    F.lit(float(p)).alias("prob"),
                    (at - F.floor(at)).alias("_part"),
                    F.lit(low).alias("low"),
                    (rank - F.col("_start")).alias("_place"),
                )
            )
    inside = F.filter(F.array(*ends), lambda e: (e["_place"] >= 0) & (e["_place"] < F.col("_w")))
    return placed.select(*keys, BUCKET, F.col("_w").alias("_size"), F.inline(inside))


def _inside(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """The rows of the wanted buckets, once per place that looks for them."""
    return _bucketed(rows, bits).join(wanted, [*keys, BUCKET]).drop(BUCKET, "_size")


def _narrow(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], bits: tuple[int, int]) -> DataFrame:
    """The same places, each in the finer bucket that holds it."""
    place = [*keys, "prob", "_part", "low", "_place"]
    finer = _bucketed(_inside(rows, wanted, keys, bits[0]), bits[1])
    counts = finer.groupBy(*place, BUCKET).agg(F.sum("_w").alias("_size"))
    start = _earlier("_size", Window.partitionBy(*place).orderBy(BUCKET))
    return (
        counts.select("*", start.alias("_start"))
        .where("_place >= _start and _place < _start + _size")
        .withColumn("_place", F.col("_place") - F.col("_start"))
        .select(*keys, BUCKET, "_size", "prob", "_part", "low", "_place")
    )


def pick(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The quantiles at the located places, with linear interpolation: ``(keys, prob, quantile)``.

    ``wanted`` is stored, so its size is known. While a bucket holds very many rows, its places are
    narrowed to finer buckets; only then are the values of a bucket put in order.
    """
    keys = list(keys)
    bits = _QUANTILE_STEPS[0]
    for finer in _QUANTILE_STEPS[1:]:
        largest = wanted.agg(F.max("_size")).first()[0]
        if largest is None or largest <= _LARGE_BUCKET:
            break
        wanted, bits = stored(_narrow(rows, wanted, keys, (bits, finer)), "places"), finer
    place = [*keys, "prob", "_part", "low", "_place"]
    values = _inside(rows, wanted, keys, bits).groupBy(*place, "_v").agg(F.sum("_w").alias("_w"))
    start = _earlier("_w", Window.partitionBy(*place).orderBy("_v"))
    hits = values.select("*", start.alias("_start")).where("_place >= _start and _place < _start + _w")
    low = F.max(F.when(F.col("low"), F.col("_v")))
    high = F.max(F.when(~F.col("low"), F.col("_v")))
    return hits.groupBy(*keys, "prob").agg((low + (high - low) * F.max("_part")).alias("quantile"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Exact quantiles per key with linear interpolation: ``(keys, prob, quantile)``.

    Two passes. The first counts rows per bucket (partial sums, so only counts travel) and stores
    the few places to look at; from its file size Spark knows whether it can be broadcast. The
    second keeps only the rows of those buckets, so the table itself is not shuffled.
    """
    rows = weighted(df, keys, value, weight)
    wanted = stored(locate(histogram(rows, keys), keys, probs), "places")
    return pick(rows, wanted, keys)


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Median per key: ``(keys, median)``."""
    return exact_quantiles(df, keys, value, [0.5], weight).select(*keys, F.col("quantile").alias("median"))


def melt(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """One row per input row and column: ``(ids, column, value)``. Expanded in place, no shuffle."""
    return df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in columns]).unpivot(
        list(ids), list(columns), "column", "value"
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of several columns in the same two passes: ``(column, prob, quantile)``."""
    return exact_quantiles(melt(df, columns), ["column"], "value", probs)


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return exact_medians(melt(df, columns), ["column"], "value")

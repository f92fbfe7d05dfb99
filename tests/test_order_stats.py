import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgewise.operators import order_stats


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v double, w bigint")


def awkward(n, seed=1):
    """Ties, zeros, both signs, extremes, and values that almost agree."""
    rng = random.Random(seed)
    pool = [0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0 + 2**-52]
    return [rng.choice([*pool, rng.gauss(0, 1), 1 + rng.random() * 1e-12, rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300)]) for _ in range(n)]


def test_running_totals_by_brute_force(spark):
    rows = [("hot", v, 2) for v in awkward(2000)] + [("cold", v, 1) for v in awkward(7, 2)] + [("cold", None, 1)]
    out = order_stats.running_totals(frame(spark, rows), ["k"], "v", ["w"]).collect()
    for key in ("hot", "cold"):
        mine = [(v, w) for k, v, w in rows if k == key and v is not None]
        distinct = sorted({v for v, _ in mine})
        got = sorted((r for r in out if r["k"] == key), key=lambda r: r["v"])
        assert [r["v"] for r in got] == distinct
        for i, r in enumerate(got):
            assert r["w"] == sum(w for v, w in mine if v == r["v"])
            assert r["w_before"] == sum(w for v, w in mine if v < r["v"])
            assert r["w_total"] == sum(w for _, w in mine)
            assert r["next_value"] == (distinct[i + 1] if i + 1 < len(distinct) else None)


@pytest.mark.parametrize("large_bucket", [5_000_000, 1])
def test_quantiles_by_brute_force(spark, monkeypatch, large_bucket):
    """With the lowest limit every place is narrowed to the finest buckets first."""
    monkeypatch.setattr(order_stats, "_LARGE_BUCKET", large_bucket)
    groups = {
        "spread": [random.Random(3).lognormvariate(5, 2) for _ in range(1001)],
        "close": [100 + i * 1e-9 for i in range(500)],
        "ties": [7.0] * 300 + [8.0] * 301,
        "mixed": [-3.0, 0.0, 0.0, 2.5],
        "one": [42.0],
    }
    rows = [(k, v, 1) for k, vs in groups.items() for v in vs] + [("spread", None, 1), (None, 1.0, 1)]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    out = order_stats.exact_quantiles(frame(spark, rows), ["k"], "v", probs).collect()
    got = {(r["k"], r["prob"]): r["quantile"] for r in out}
    assert len(got) == len(groups) * len(probs)
    for k, vs in groups.items():
        for p in probs:
            assert math.isclose(got[k, p], np.quantile(vs, p), rel_tol=1e-12, abs_tol=1e-300)


def test_weights_count_as_copies(spark):
    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", 10.0, 2)]
    out = order_stats.exact_medians(frame(spark, rows), ["k"], "v", "w").first()
    assert out["median"] == np.median([1, 1, 1, 2, 10, 10])


def test_buckets_are_monotone_and_nest(spark):
    df = frame(spark, [("a", v, 1) for v in awkward(3000)])
    rows = df.select("v", *[order_stats.bucket_of(F.col("v"), b).alias(f"b{b}") for b in (12, 20, 28)]).collect()
    rows.sort(key=lambda r: r["v"])
    for a, b in zip(rows, rows[1:]):
        assert a["b12"] <= b["b12"] and a["b20"] <= b["b20"] and a["b28"] <= b["b28"]
    assert all(r["b28"] >> 8 == r["b20"] and r["b20"] >> 8 == r["b12"] for r in rows)


def test_column_quantiles_skip_gaps(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (4, None), (9, 7.0)], "a int, b double")
    assert {r["column"]: r["median"] for r in order_stats.column_medians(df, ["a", "b"]).collect()} == {"a": 3.0, "b": 6.0}


def test_images_keep_the_order_of_doubles(spark):
    values = sorted({*awkward(3000, 5), *(2.0**e for e in range(-1074, 1024)), *(np.nextafter(2.0**e, 0) for e in range(-1070, 1024)), 1.7976931348623157e308})
    values = [-math.inf, *sorted(-v for v in values if v > 0), *values, math.inf]
    rows = spark.createDataFrame([(float(v),) for v in sorted(set(values))], "v double").select("v", order_stats.image_of(F.col("v")).alias("i")).collect()
    for r in rows:
        bits = int(np.float64(abs(r["v"])).view(np.int64))
        assert r["i"] == (bits if r["v"] >= 0 else -bits)


def window_sizes(plan_rows, key):
    return plan_rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]


@pytest.mark.parametrize("case", ["close together", "over 300 decades"])
def test_running_totals_stay_in_bounded_windows(spark, case):
    """A million distinct values in one coarse bucket, and values of every size."""
    ids = spark.range(0, 1_000_000, 1, 8)
    if case == "close together":
        v = F.lit(1.0) + F.col("id") * float(2**-52)
    else:
        v = F.pow(F.lit(10.0), F.col("id") / 3333.0 - 150) * F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    df = ids.select(F.lit("k").alias("k"), v.alias("v"), F.lit(1).cast("bigint").alias("w"))
    images = df.select(order_stats.image_of(F.col("v")).alias("i")).distinct()
    for level in range(4):
        node = images.select(F.shiftright("i", 16 * level).alias("b")).distinct().withColumn("p", F.shiftright("b", 16))
        assert window_sizes(node, ["p"] if level < 3 else []) <= order_stats.WINDOW_ROWS
    out = order_stats.running_totals(df, ["k"], "v", ["w"])
    n = images.count()
    told = out.agg(F.count("*"), F.sum("w_before"), F.min("w_total"), F.count("next_value"), F.sum((F.col("next_value") > F.col("v")).cast("int"))).first()
    assert tuple(told)[:1] == (n,) and told[1] == n * (n - 1) // 2 and told[2] == 1_000_000 and told[3] == told[4] == n - 1

import math
import random

from lodgewise.operators import drift
from lodgewise.plans import monitoring

SCHEMA = "x double, c string, b string"


def frame(spark, n, shift=0.0, c="abc", seed=1, b=0.5):
    rng = random.Random(seed)
    rows = [(round(rng.gauss(shift, 1), 2), rng.choice(c), "yes" if rng.random() < b else "no") for _ in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def cdf_gaps(a, b):
    points = sorted({*a, *b})
    gaps = [abs(sum(v <= p for v in a) / len(a) - sum(v <= p for v in b) / len(b)) for p in points]
    return points, gaps


def test_ks_and_wasserstein_by_brute_force(spark):
    (r, ref), (c, cur) = frame(spark, 150), frame(spark, 100, 0.4, seed=2)
    a, b = [x for x, *_ in r], [x for x, *_ in c]
    points, gaps = cdf_gaps(a, b)
    assert math.isclose(drift.ks(ref, cur, ["x"]).first()["statistic"], max(gaps), rel_tol=1e-12)
    area = sum(g * (q - p) for g, p, q in zip(gaps, points, points[1:]))
    mean = sum(a) / len(a)
    spread = math.sqrt(sum((v - mean) ** 2 for v in a) / len(a))
    out = drift.wasserstein(ref, cur, ["x"]).first()
    assert math.isclose(out["statistic"], area, rel_tol=1e-9)
    assert math.isclose(out["score"], area / spread, rel_tol=1e-9)


def test_a_frame_does_not_drift_from_itself(spark):
    _, df = frame(spark, 200)
    columns, summary = monitoring.monitor_drift(df, df)
    assert [r["drifted"] for r in columns.collect()] == [False] * 3
    out = summary.first()
    assert (out["n_features"], out["drift_share"], out["dataset_drift"], out["critical_drift"]) == (3, 0.0, False, False)


def test_drift_is_found_and_counted(spark, tmp_path):
    _, ref = frame(spark, 200)
    _, cur = frame(spark, 200, 3.0, c="aab", seed=2, b=0.95)
    columns, summary = monitoring.monitor_drift(ref, cur, output=str(tmp_path))
    assert {r["column"]: r["method"] for r in columns.collect()} == {"x": "wasserstein", "c": "jensen_shannon", "b": "jensen_shannon"}
    out = summary.first()
    assert out["drifted_features"] == "b,c,x" and out["dataset_drift"] and out["critical_drift"]
    assert spark.read.json(str(tmp_path / "columns")).count() == 3


def test_methods_depend_on_no_size_and_can_be_named(spark):
    for n in (50, 1001):
        _, df = frame(spark, n)
        out = {r["column"]: r["method"] for r in drift.column_drift(df, df, ["x"], ["c", "b"]).collect()}
        assert out == {"x": "wasserstein", "c": "jensen_shannon", "b": "jensen_shannon"}
    named = drift.column_drift(df, df, [], [], {"ks": ["x"], "wasserstein": ["x"], "chi2": ["c"], "z": ["b"]})
    assert sorted((r["column"], r["method"], r["drifted"]) for r in named.collect()) == [
        ("b", "z", False),
        ("c", "chi2", False),
        ("x", "ks", False),
        ("x", "wasserstein", False),
    ]
    out = drift.jensen_shannon(df, df, ["c"]).first()
    assert (out["score"], out["score_kind"], out["drifted"]) == (0.0, "distance", False)


def test_disjoint_categories_are_as_far_as_can_be(spark):
    ref, cur = (spark.createDataFrame([(0.0, c, "y")], SCHEMA) for c in "ab")
    assert math.isclose(drift.jensen_shannon(ref, cur, ["c"]).first()["score"], math.sqrt(math.log(2)))
    out = drift.chi2(ref, cur, ["c"]).first()
    assert out["score"] == 0.0 and out["drifted"]


def test_chi2_and_z_by_hand(spark):
    ref = spark.createDataFrame([(0.0, "a", "n")] * 60 + [(0.0, "b", "y")] * 40, SCHEMA)
    cur = spark.createDataFrame([(0.0, "a", "n")] * 25 + [(0.0, "b", "y")] * 25, SCHEMA)
    assert math.isclose(drift.chi2(ref, cur, ["c"]).first()["statistic"], 25 / 30 + 25 / 20, rel_tol=1e-12)
    pooled = 85 / 150
    z = (0.6 - 0.5) / math.sqrt(pooled * (1 - pooled) * (1 / 100 + 1 / 50))
    out = drift.z_proportion(ref, cur, ["b"]).first()
    assert math.isclose(out["statistic"], z) and math.isclose(out["score"], math.erfc(z / math.sqrt(2)))

import math
from fractions import Fraction

import numpy as np
import pytest

from lodgewise.functions.distributions import chi2_tail, kolmogorov_tail, normal_two_sided, t_two_sided
from lodgewise.operators import stats


@pytest.mark.parametrize(
    "x, dof, p",
    [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (2.0, 2, math.exp(-1)), (0.0, 3, 1.0), (6.634896601021213, 1, 0.01)],
)
def test_chi2_tail_at_known_points(x, dof, p):
    assert math.isclose(chi2_tail(x, dof), p, rel_tol=1e-9)


def test_chi2_tail_of_one_degree_is_erfc():
    for x in (0.01, 0.5, 1.0, 4.0, 30.0, 200.0):
        assert math.isclose(chi2_tail(x, 1), math.erfc(math.sqrt(x / 2)), rel_tol=1e-9)


def test_t_tail_at_known_points():
    assert math.isclose(t_two_sided(12.706204736432095, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(t_two_sided(1.0, 1), 0.5, rel_tol=1e-12)
    assert t_two_sided(0.0, 5) == 1.0
    assert math.isclose(t_two_sided(2.0, 1e7), normal_two_sided(2.0), rel_tol=1e-5)


def test_other_tails():
    assert math.isclose(kolmogorov_tail(1.3580986393225505), 0.05, rel_tol=1e-6)
    assert kolmogorov_tail(0.01) == 1.0
    assert math.isclose(normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)


def counts(spark, table):
    rows = [(a, b) for (a, b), n in table.items() for _ in range(n)]
    return spark.createDataFrame(rows, "c string, no_show int")


def test_two_by_two_has_the_continuity_correction(spark):
    df = counts(spark, {("x", 0): 10, ("x", 1): 20, ("y", 0): 30, ("y", 1): 5})
    out = stats.chi_square(df, ["c"]).first()
    a, b, c, d = 10, 20, 30, 5
    want = 65 * (abs(a * d - b * c) - 65 / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert out["dof"] == 1
    assert math.isclose(out["chi2"], want, rel_tol=1e-12)
    assert math.isclose(out["p_value"], math.erfc(math.sqrt(want / 2)), rel_tol=1e-9)


def test_empty_cells_count(spark):
    df = counts(spark, {("x", 0): 12, ("y", 1): 7, ("z", 0): 5, ("z", 1): 6})
    observed = np.array([[12, 0], [0, 7], [5, 6]], float)
    expected = observed.sum(1, keepdims=True) * observed.sum(0, keepdims=True) / observed.sum()
    out = stats.chi_square(df, ["c"]).first()
    assert math.isclose(out["chi2"], ((observed - expected) ** 2 / expected).sum(), rel_tol=1e-12)
    assert math.isclose(out["cramers_v"], math.sqrt(out["chi2"] / 30), rel_tol=1e-12)


def test_one_value_has_no_association(spark):
    out = stats.chi_square(counts(spark, {("x", 0): 3, ("x", 1): 4}), ["c"]).first()
    assert (out["chi2"], out["cramers_v"], out["dof"], out["p_value"]) == (0.0, 0.0, 0, 1.0)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    x[:, 2] = 0.8 * x[:, 0] + 0.3 * rng.normal(size=200)
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    rows = [(*map(float, r), float(r[0] + r[1]), None if i == 0 else 1.0, int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, total double, gap double, no_show int")


def test_vif_by_regression(numbers):
    x, _, df = numbers
    got = {r["feature"]: r["vif"] for r in stats.vif(df, ["a", "b", "c", "gap"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for i, name in enumerate("abc"):
        others = np.column_stack([np.ones(200), np.delete(x, i, axis=1)])
        rest = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        r2 = 1 - rest.var() / x[:, i].var()
        assert math.isclose(got[name], 1 / (1 - r2), rel_tol=1e-9)


def test_vif_is_infinite_for_a_sum(numbers):
    got = {r["feature"]: r["vif"] for r in stats.vif(numbers[2], ["a", "b", "total"]).collect()}
    assert all(math.isinf(v) for v in got.values())


def test_point_biserial_and_pearson(numbers):
    x, y, df = numbers
    out = {r["feature"]: r for r in stats.point_biserial(df, ["a", "b"]).collect()}
    r = np.corrcoef(y, x[:, 0])[0, 1]
    assert math.isclose(out["a"]["correlation"], r, rel_tol=1e-9)
    assert math.isclose(out["a"]["p_value"], t_two_sided(r * math.sqrt(198 / (1 - r * r)), 198), rel_tol=1e-6)
    matrix = {(p["a"], p["b"]): p["r"] for p in stats.pearson_matrix(df, ["a", "b", "c"]).collect()}
    assert len(matrix) == 9 and matrix["a", "a"] == 1.0
    assert math.isclose(matrix["c", "a"], np.corrcoef(x[:, 0], x[:, 2])[0, 1], rel_tol=1e-9)
    assert [tuple(p)[:2] for p in stats.high_corr_pairs(df, ["a", "b", "c"]).collect()] == [("a", "c")]


def test_ranking_joins_both_kinds(spark, clean_bookings):
    out = stats.feature_ranking(clean_bookings, ["price", "num_adults"], ["branch", "room"]).collect()
    assert out[0]["feature"] == "price" and out[0]["stars"] == "***"
    assert {r["type"] for r in out} == {"numerical", "categorical"}
    strengths = [r["abs_correlation"] for r in out]
    assert strengths == sorted(strengths, reverse=True)


def test_tails_at_large_degrees_of_freedom():
    from lodgewise.functions import distributions

    assert abs(distributions.chi2_tail(1e10, 1e10) - 0.4999981) < 1e-7
    assert abs(distributions.t_two_sided(2.0, 1e12) - 0.0455002639) < 1e-10
    for x in (0.999e6, 1e6, 1.001e6, 1.003e6):  # the exact forms go over into the normal ones
        exact, near = distributions.chi2_tail(x, 1e6), distributions.chi2_tail(x * (1 + 1e-9), 1e6 * (1 + 1e-9))
        assert abs(exact - near) < 1e-5


def test_chi_square_of_many_rows_does_not_cancel(spark):
    million = 10**12
    cells = [("x", "y", r, c, float(million + (r == c))) for r in "pqr" for c in "stu"[:3]]
    cells = [(a, b, r, c, o + (("p", "s") == (r, c))) for a, b, r, c, o in cells]
    got = stats.chi_square_of(spark.createDataFrame(cells, "a string, b string, va string, vb string, o double")).first()
    n = sum(o for *_, o in cells)
    row = {r: sum(o for _, _, v, _, o in cells if v == r) for r in "pqr"}
    col = {c: sum(o for _, _, _, v, o in cells if v == c) for c in "stu"}
    want = sum(float((Fraction(o) - Fraction(row[r]) * Fraction(col[c]) / Fraction(n)) ** 2 / (Fraction(row[r]) * Fraction(col[c]) / Fraction(n))) for _, _, r, c, o in cells)
    assert got["dof"] == 4 and got["chi2"] == pytest.approx(want, rel=1e-2)


def test_chi_square_counts_empty_cells(spark):
    rows = [("a", 1)] * 5 + [("b", 2)] * 7 + [("c", 3)] * 4 + [("a", 2)] * 2
    got = stats.chi_square(spark.createDataFrame(rows, "f string, no_show int"), ["f"]).first()
    n, seen = len(rows), {x: rows.count(x) for x in set(rows)}
    want = 0.0
    for f in "abc":
        for t in (1, 2, 3):
            e = sum(x == f for x, _ in rows) * sum(y == t for _, y in rows) / n
            want += (seen.get((f, t), 0) - e) ** 2 / e
    assert got["chi2"] == pytest.approx(want)

"""Association statistics: correlations, contingency tests, collinearity, ranking."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgewise.functions.distributions import chi2_p, t_p
from lodgewise.schema import ROLES

HIGH_CORRELATION = 0.7
HIGH_ASSOCIATION = 0.5
HIGH_VIF = 10.0
SIGNIFICANCE = 0.05
PERFECT_R2 = 0.9999


def _rows(cells: Sequence[Column]) -> Column:
    return F.inline(F.array(*cells))


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """r of each column pair, in one scan: ``(a, b, r)`` for a before b."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(
        _rows([F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    )


def _mirrored(pairs: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """Upper triangle to the whole matrix with a unit diagonal."""
    flipped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value)
    diagonal = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], f"a string, b string, {value} double")
    return pairs.unionByName(flipped).unionByName(diagonal)


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _mirrored(pearson_pairs(df, columns), columns, "r")


def high_corr_pairs(df: DataFrame, columns: Sequence[str], limit: float = HIGH_CORRELATION) -> DataFrame:
    return pearson_pairs(df, columns).where(F.abs("r") > limit)


def point_biserial(df: DataFrame, columns: Sequence[str], target: str = ROLES.target) -> DataFrame:
    """Correlation of numeric columns with a 0/1 target and its two-sided p: strongest first."""
    y = F.col(target).cast("double")
    aggregates = []
    for c in columns:
        x = F.col(c).cast("double")
        aggregates += [F.corr(y, x).alias(f"{c}_r"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"{c}_n")]
    table = df.agg(*aggregates).select(
        _rows(
            [
                F.struct(F.lit(c).alias("feature"), F.col(f"{c}_r").alias("correlation"), F.col(f"{c}_n").alias("n"))
                for c in columns
            ]
        )
    )
    r, dof = F.col("correlation"), F.col("n") - 2
    t = F.coalesce(F.try_divide(F.abs(r) * F.sqrt(dof), F.sqrt(1 - r * r)), F.when(F.abs(r) >= 1, F.lit(float("inf"))))
    return table.withColumn("p_value", t_p(t, dof)).orderBy(F.desc(F.abs("correlation")), "feature")


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Counts per value pair of several column pairs in one scan: ``(a, b, va, vb, o)``.

    Rows are expanded to one per column pair and summed at once, so cells travel and rows do not.
    """
    cells = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.col(a).cast("string").alias("va"),
            F.col(b).cast("string").alias("vb"),
        )
        for a, b in pairs
    ]
    return (
        df.select(_rows(cells))
        .where("va is not null and vb is not null")
        .groupBy("a", "b", "va", "vb")
        .agg(F.count("*").cast("double").alias("o"))
    )


def chi_square_of(cells: DataFrame) -> DataFrame:
    """Test of independence per column pair: ``(a, b, n, chi2, dof, cramers_v)``.

    Cells that occur add (o - e)^2 / e. The empty ones of a row add their e, which is the row's share
    of n less the columns that the row meets, a difference of whole numbers; so the table is never
    filled up and nothing cancels. With one degree of freedom the continuity correction applies:
    there |o - e| is the same in all four cells.
    """
    pair = ["a", "b"]
    by_row = cells.groupBy(*pair, "va").agg(F.sum("o").alias("row"))
    by_col = cells.groupBy(*pair, "vb").agg(F.sum("o").alias("col"))
    rows = by_row.groupBy(*pair).agg(F.count("*").alias("r"), F.sum(1 / F.col("row")).alias("inv_row"), F.sum("row").alias("n"))
    cols = by_col.groupBy(*pair).agg(F.count("*").alias("c"), F.sum(1 / F.col("col")).alias("inv_col"))
    margins = rows.join(cols, pair)
    o, row, col, n = F.col("o"), F.col("row"), F.col("col"), F.col("n")
    expected = row * col / n
    sums = (
        cells.join(by_row, [*pair, "va"])
        .join(by_col, [*pair, "vb"])
        .join(margins, pair)
        .groupBy(*pair, "n", "r", "c", "inv_row", "inv_col", "va", "row")
        .agg(F.sum(F.pow(o - expected, 2) / expected).alias("full"), F.sum("col").alias("met"), F.max(F.abs(o - expected)).alias("gap"))
        .groupBy(*pair, "n", "r", "c", "inv_row", "inv_col")
        .agg(F.sum(F.col("full") + row / n * (n - F.col("met"))).alias("plain"), F.max("gap").alias("gap"))
    )
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    corrected = F.pow(F.greatest(F.col("gap") - 0.5, F.lit(0.0)), 2) * n * F.col("inv_row") * F.col("inv_col")
    smaller = F.least("r", "c") - 1
    chi2 = F.when(dof == 1, corrected).when(dof == 0, F.lit(0.0)).otherwise(F.col("plain"))
    return sums.withColumns({"dof": dof, "chi2": chi2}).select(
        *pair,
        n.cast("bigint").alias("n"),
        "chi2",
        "dof",
        F.coalesce(F.sqrt(F.try_divide("chi2", n * smaller)), F.lit(0.0)).alias("cramers_v"),
    )


def chi_square(df: DataFrame, columns: Sequence[str], target: str = ROLES.target) -> DataFrame:
    """Each categorical column against the target, strongest first."""
    tests = chi_square_of(contingency(df, [(c, target) for c in columns]))
    p = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(chi2_p(F.col("chi2"), F.col("dof")))
    return tests.select(F.col("a").alias("feature"), "cramers_v", "chi2", "dof", p.alias("p_value")).orderBy(
        F.desc("cramers_v"), "feature"
    )


def significant_features(tests: DataFrame, level: float = SIGNIFICANCE) -> DataFrame:
    return tests.where(F.col("p_value") < level)


def cramers_v_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return chi_square_of(contingency(df, list(combinations(columns, 2)))).select("a", "b", "cramers_v")


def cramers_v_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _mirrored(cramers_v_pairs(df, columns), columns, "cramers_v")


def high_assoc_pairs(df: DataFrame, columns: Sequence[str], limit: float = HIGH_ASSOCIATION) -> DataFrame:
    return cramers_v_pairs(df, columns).where(F.col("cramers_v") > limit)


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation per column against the others; infinite under perfect collinearity.

    Columns with gaps are left out. Only the correlation matrix of the columns reaches the driver;
    R^2 of a regression on standardised columns follows from it.
    """
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    kept = [c for c in columns if gaps[c] == 0]
    at = {c: i for i, c in enumerate(kept)}
    matrix = np.eye(len(kept))
    if len(kept) > 1:
        for row in pearson_pairs(df, kept).collect():
            i, j = at[row["a"]], at[row["b"]]
            matrix[i, j] = matrix[j, i] = 0.0 if row["r"] is None or np.isnan(row["r"]) else row["r"]
    out = []
    for c, i in at.items():
        others = [j for j in range(len(kept)) if j != i]
        r2 = float(matrix[i, others] @ np.linalg.pinv(matrix[np.ix_(others, others)], hermitian=True) @ matrix[others, i])
        out.append((c, 1.0 / (1.0 - r2) if r2 < PERFECT_R2 else float("inf")))
    table = df.sparkSession.createDataFrame(out, "feature string, vif double")
    return table.select("feature", "vif", (F.col("vif") > HIGH_VIF).alias("flagged")).orderBy(F.desc("vif"), "feature")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def feature_ranking(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str = ROLES.target,
    top: int | None = None,
    with_vif: bool = True,
) -> DataFrame:
    """Numeric and categorical features together, by strength of association with the target."""
    left = point_biserial(df, numeric, target).select(
        "feature", F.lit("numerical").alias("type"), "correlation", "p_value"
    )
    right = chi_square(df, categorical, target).select(
        "feature", F.lit("categorical").alias("type"), F.col("cramers_v").alias("correlation"), "p_value"
    )
    table = left.unionByName(right).withColumns(
        {"abs_correlation": F.abs("correlation"), "stars": stars(F.col("p_value"))}
    )
    if with_vif:
        table = table.join(F.broadcast(vif(df, numeric).select("feature", "vif")), "feature", "left")
    ranked = table.orderBy(F.desc("abs_correlation"), "feature")
    return ranked.limit(top) if top else ranked

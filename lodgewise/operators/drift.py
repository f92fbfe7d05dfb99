"""Drift between a reference and a current frame, column by column.

All columns of a kind are compared in one pass over the union of both frames. Two kinds of score
exist: p-values drift when small, distances drift when large; ``score_kind`` says which.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgewise.functions.distributions import chi2_p, kolmogorov_p, normal_p
from lodgewise.operators.order_stats import exact_quantiles, melt, running_totals
from lodgewise.schema import (
    CRITICAL_DRIFT_SHARE,
    DATASET_DRIFT_SHARE,
    DRIFT_DISTANCE,
    DRIFT_P_VALUE,
)

P_VALUE, DISTANCE = "p_value", "distance"
_SMALLEST_SPREAD = 0.001  # a constant reference column is not divided by zero


def _both(reference: DataFrame, current: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """``(column, value, ref, cur)`` with 1 in the column of the frame a row came from."""
    sides = [
        melt(frame, columns, kind=kind)
        .where("value is not null")
        .select("column", "value", F.lit(r).cast("bigint").alias("ref"), F.lit(c).cast("bigint").alias("cur"))
        for frame, r, c in ((reference, 1, 0), (current, 0, 1))
    ]
    return sides[0].unionByName(sides[1])


def _result(table: DataFrame, method: str, score: Column, kind: str) -> DataFrame:
    limit = DRIFT_P_VALUE if kind == P_VALUE else DRIFT_DISTANCE
    drifted = score < limit if kind == P_VALUE else score >= limit
    return table.select(
        "column",
        F.lit(method).alias("method"),
        F.col("statistic").cast("double").alias("statistic"),
        score.cast("double").alias("score"),
        F.lit(kind).alias("score_kind"),
        F.coalesce(drifted, F.lit(False)).alias("drifted"),
    )


def _distribution_gap(steps: DataFrame) -> DataFrame:
    """Distance of both distribution functions right after each distinct value."""
    ref = (F.col("ref_before") + F.col("ref")) / F.col("ref_total")
    cur = (F.col("cur_before") + F.col("cur")) / F.col("cur_total")
    return steps.where("ref_total > 0 and cur_total > 0").withColumn("gap", F.abs(ref - cur))


def ks(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov; p from the limiting distribution."""
    steps = _distribution_gap(running_totals(_both(reference, current, columns, "double"), ["column"], "value", ["ref", "cur"]))
    d = steps.groupBy("column", "ref_total", "cur_total").agg(F.max("gap").alias("statistic"))
    scaled = F.col("statistic") * F.sqrt(
        F.col("ref_total").cast("double") * F.col("cur_total") / (F.col("ref_total") + F.col("cur_total"))
    )
    return _result(d.withColumn("p", kolmogorov_p(scaled)), "ks", F.col("p"), P_VALUE)


def wasserstein(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Earth mover's distance in units of the reference deviation."""
    steps = _distribution_gap(running_totals(_both(reference, current, columns, "double"), ["column"], "value", ["ref", "cur"]))
    area = steps.groupBy("column").agg(
        F.coalesce(F.sum(F.col("gap") * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("statistic")
    )
    spread = melt(reference, columns).groupBy("column").agg(F.stddev_pop("value").alias("spread"))
    table = area.join(F.broadcast(spread), "column")
    norm = F.greatest(F.coalesce("spread", F.lit(0.0)), F.lit(_SMALLEST_SPREAD))
    return _result(table, "wasserstein", F.col("statistic") / norm, DISTANCE)


def _category_counts(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per column and value in both frames, with both totals per column."""
    counts = (
        _both(reference, current, columns, "string")
        .groupBy("column", "value")
        .agg(F.sum("ref").cast("double").alias("ref"), F.sum("cur").cast("double").alias("cur"))
    )
    totals = counts.groupBy("column").agg(
        F.sum("ref").alias("ref_n"), F.sum("cur").alias("cur_n"), F.count("*").alias("k"), F.min("value").alias("first")
    )
    return counts.join(F.broadcast(totals), "column")


def chi2(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Current counts against reference counts scaled to the same total; unseen values are infinite."""
    expected = F.col("ref") * F.col("cur_n") / F.col("ref_n")
    term = F.coalesce(
        F.try_divide(F.pow(F.col("cur") - expected, 2), expected), F.when(F.col("cur") > 0, float("inf")).otherwise(0.0)
    )
    table = (
        _category_counts(reference, current, columns)
        .groupBy("column", "k")
        .agg(F.sum(term).alias("statistic"))
        .withColumn("p", F.when(F.col("k") == 1, F.lit(1.0)).otherwise(chi2_p(F.col("statistic"), F.col("k") - 1)))
    )
    return _result(table, "chi2", F.col("p"), P_VALUE)


def z_proportion(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of the first value in both frames, for columns with two values."""
    table = _category_counts(reference, current, columns).where(F.col("value") == F.col("first"))
    p1, p2 = F.col("ref") / F.col("ref_n"), F.col("cur") / F.col("cur_n")
    pooled = (F.col("ref") + F.col("cur")) / (F.col("ref_n") + F.col("cur_n"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("ref_n") + 1 / F.col("cur_n")))
    z = F.when(p1 == p2, F.lit(0.0)).otherwise(F.try_divide(p1 - p2, error))
    table = table.withColumn("statistic", z).withColumn("p", normal_p(F.col("statistic")))
    return _result(table, "z", F.col("p"), P_VALUE)


def jensen_shannon(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Jensen-Shannon distance of the value shares (natural logarithm)."""
    p, q = F.col("ref") / F.col("ref_n"), F.col("cur") / F.col("cur_n")
    middle = (p + q) / 2

    def part(share: Column) -> Column:
        return F.when(share > 0, share * F.ln(share / middle)).otherwise(0.0)

    table = (
        _category_counts(reference, current, columns)
        .groupBy("column")
        .agg(F.greatest(F.sum(part(p) + part(q)) / 2, F.lit(0.0)).alias("divergence"))
        .withColumn("statistic", F.sqrt("divergence"))
    )
    return _result(table, "jensen_shannon", F.col("statistic"), DISTANCE)


METHODS = {"ks": ks, "wasserstein": wasserstein, "chi2": chi2, "z": z_proportion, "jensen_shannon": jensen_shannon}


def column_drift(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    methods: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One score per role column.

    ``methods`` names the columns of each method, and a column may have several. By default, and at every size,
    numeric columns are compared by Wasserstein distance and categories by Jensen-Shannon distance.
    """
    chosen = methods or {"wasserstein": numeric, "jensen_shannon": categorical}
    parts = [METHODS[m](reference, current, columns) for m, columns in sorted(chosen.items()) if columns]
    if not parts:
        raise ValueError("no columns to compare")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drift_summary(columns: DataFrame) -> DataFrame:
    """Share of drifted columns and the two alarms."""
    share = F.try_divide(F.col("n_drifted_features"), F.col("n_features"))
    return (
        columns.agg(
            F.count("*").alias("n_features"),
            F.count_if("drifted").alias("n_drifted_features"),
            F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("column")))).alias("names"),
        )
        .withColumn("drift_share", share)
        .select(
            "n_features",
            "n_drifted_features",
            "drift_share",
            F.array_join("names", ",").alias("drifted_features"),
            (F.col("drift_share") > DATASET_DRIFT_SHARE).alias("dataset_drift"),
            (F.col("drift_share") > CRITICAL_DRIFT_SHARE).alias("critical_drift"),
        )
    )


def data_summary(frames: dict[str, DataFrame], numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Per frame and column: rows, gaps, distinct values; for numbers also moments and quartiles.

    All frames go through each pass together. Joins are on one row per frame and column.
    """
    columns, key = [*numeric, *categorical], ["frame", "column"]
    parts = [df.select(F.lit(name).alias("frame"), *columns) for name, df in frames.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    per_value = melt(rows, columns, ["frame"], "string").groupBy(*key, "value").agg(F.count("*").alias("n"))
    counts = per_value.groupBy(*key).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("distinct"),
    )
    values = melt(rows, numeric, ["frame"])
    moments = values.groupBy(*key).agg(
        F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    quartiles = (
        exact_quantiles(values, key, "value", [0.25, 0.5, 0.75])
        .groupBy(*key)
        .pivot("prob", [0.25, 0.5, 0.75])
        .agg(F.first("quantile"))
        .toDF(*key, "q25", "q50", "q75")
    )
    return counts.join(F.broadcast(moments), key, "left").join(F.broadcast(quartiles), key, "left")

"""Data-quality profile of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgewise.functions.clean import number
from lodgewise.operators import order_stats
from lodgewise.operators.aggregates import distinct_counts
from lodgewise.schema import ROLES
from lodgewise.session import stored


def column_summary(df: DataFrame) -> DataFrame:
    """Type, non-NULL count and distinct count per column, fullest first."""
    types = df.sparkSession.createDataFrame(df.dtypes, "column string, type string")
    counts = distinct_counts(df, df.columns)
    return (
        counts.join(F.broadcast(types), "column")
        .select("column", "type", "non_null", "distinct")
        .orderBy(F.desc("non_null"), F.desc("distinct"), "column")
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percentage of the columns that have gaps, most first."""
    columns = df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count("*").alias("_rows"))
    return (
        row.unpivot(["_rows"], columns, "column", "missing")
        .where("missing > 0")
        .select("column", "missing", F.round(F.col("missing") / F.col("_rows") * 100, 2).alias("missing_pct"))
        .orderBy(F.desc("missing"), "column")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in all columns, and their share.

    Copies are summed before the shuffle, so a large group of them is one partial row per task.
    """
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return copies.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.round(F.try_divide(F.sum(F.col("n") - 1), F.sum("n")) * 100, 2).alias("duplicate_pct"),
    )


def null_target_count(df: DataFrame, target: str = ROLES.target) -> DataFrame:
    return df.agg(F.count_if(F.col(target).isNull()).alias("null_target"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def negative_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative values per column."""
    row = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "negatives")


def non_numeric_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column that hold text but no number; ``(any)`` counts rows with such a column."""
    bad = {c: number(df, c).isNull() & F.col(c).isNotNull() for c in columns}
    either = F.lit(False)
    for flag in bad.values():
        either = either | flag
    row = df.agg(
        *[F.count_if(flag).alias(c) for c, flag in bad.items()], F.count_if(either).alias("(any)"), F.count("*").alias("_n")
    )
    return row.unpivot(["_n"], [*columns, "(any)"], "column", "non_numeric").select(
        "column", "non_numeric", F.try_divide(F.col("non_numeric"), F.col("_n")).alias("share")
    )


def non_numeric_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The texts behind the report, with counts."""
    frames = [
        df.where(number(df, c).isNull() & F.col(c).isNotNull())
        .groupBy(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
        for c in columns
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def guest_validity(df: DataFrame) -> DataFrame:
    """Bookings without guests and without adults."""
    return df.agg(
        F.count_if(F.col("num_adults") + F.col("num_children") == 0).alias("zero_guests"),
        F.count_if(F.col("num_adults") <= 0).alias("invalid_adults"),
        F.count("*").alias("bookings"),
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Values outside the interquartile fences; columns without any are left out."""
    quartiles = (
        order_stats.column_quantiles(df, columns, [0.25, 0.75])
        .groupBy("column")
        .agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
            F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"),
        )
    )
    reach = (F.col("q3") - F.col("q1")) * factor
    fences = stored(
        quartiles.select("column", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper")), "fences"
    )
    return (
        order_stats.melt(df, columns)
        .join(fences, "column")
        .groupBy("column", "lower", "upper")
        .agg(F.count_if(F.expr("value < lower or value > upper")).alias("outliers"), F.count("*").alias("_n"))
        .where("outliers > 0")
        .select("column", "outliers", (F.col("outliers") / F.col("_n") * 100).alias("pct"), "lower", "upper")
    )

"""Dashboard and distribution queries: plain partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgewise.operators import order_stats
from lodgewise.schema import ROLES
from lodgewise.session import stored

TARGET = ROLES.target


def kpis(df: DataFrame) -> DataFrame:
    """Bookings, no-show rate, average price, and the price at stake in no-shows."""
    return df.agg(
        F.count("*").alias("bookings"),
        F.avg(TARGET).alias("no_show_rate"),
        F.avg("price").alias("avg_price"),
        F.sum(F.when(F.col(TARGET) == 1, F.col("price"))).alias("revenue_at_risk"),
    )


def rate_by(df: DataFrame, column: str) -> DataFrame:
    """No-show rate in percent per value of a column."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg((F.avg(TARGET) * 100).alias("no_show_pct"))


def rate_by_first_time(df: DataFrame) -> DataFrame:
    """The same over Yes/No guests, relabelled; other values are left out."""
    label = F.when(F.col("first_time") == 1, "First-Time").when(F.col("first_time") == 0, "Returning")
    known = df.na.drop(subset=["first_time"])
    return known.groupBy(label.alias("guest")).agg((F.avg(TARGET) * 100).alias("no_show_pct"))


def rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rate in percent and size for each value of each column, all columns in one pass."""
    return (
        order_stats.melt(df, columns, [TARGET], "string")
        .where("value is not null")
        .groupBy("column", "value")
        .agg((F.avg(TARGET) * 100).alias("no_show_pct"), F.count("*").alias("n"))
    )


def rate_by_column(df: DataFrame, column: str) -> DataFrame:
    return rates(df, [column]).drop("column").orderBy("no_show_pct", "value")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-NULL and distinct values per column: ``(column, non_null, distinct)``.

    First one row per column and value, then one per column: a hot value or column is already
    reduced before it moves.
    """
    per_value = order_stats.melt(df, columns, kind="string").groupBy("column", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
        F.count("value").alias("distinct"),
    )


def rate_by_quantile(df: DataFrame, columns: Sequence[str], bins: int = 5, min_distinct: int = 13) -> DataFrame:
    """Rate per quantile bin; equal edges are merged. Columns of fewer than ``min_distinct`` values have a bin per value.

    Bins are open below and closed above; the first one includes its lower edge. A value's bin begins and ends with it.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = (
        order_stats.column_quantiles(df, columns, probs)
        .groupBy("column")
        .agg(F.array_distinct(F.array_sort(F.collect_list("quantile"))).alias("edges"))
    )
    many = distinct_counts(df, columns).select("column", (F.col("distinct") >= min_distinct).alias("many"))
    edges = stored(edges.join(many, "column"), "edges")
    rate = [(F.avg(TARGET) * 100).alias("no_show_pct"), F.count("*").alias("n")]
    rows = order_stats.melt(df, columns, [TARGET]).where("value is not null").join(edges, "column")
    index = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("value"))))
    binned = (
        rows.where("many")
        .select("column", "edges", index.alias("bin"), TARGET)
        .groupBy("column", "bin", "edges")
        .agg(*rate)
        .select(
            "column",
            "bin",
            F.get("edges", F.col("bin") - 1).alias("lower"),
            F.get("edges", F.col("bin")).alias("upper"),
            "no_show_pct",
            "n",
        )
    )
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))  # of fewer than min_distinct values
    valued = (
        rows.where("not many")
        .groupBy("column", "value")
        .agg(*rate)
        .select("column", place.alias("bin"), F.col("value").alias("lower"), F.col("value").alias("upper"), "no_show_pct", "n")
    )
    return binned.unionByName(valued)


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 1..bins; the maximum belongs to the last one."""
    return F.least(F.width_bucket(value, low, high, F.lit(bins)), F.lit(bins)).cast("int")


def histogram(df: DataFrame, columns: Sequence[str], bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts of numeric columns, optionally per ``by``: empty bins are left out.

    A column with one value gets a range of one unit around it.
    """
    values = order_stats.melt(df, columns, by).where("value is not null")
    ranges = values.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    flat = F.col("low") == F.col("high")
    pad = F.when(flat, 0.5).otherwise(0.0)
    ranges = stored(
        ranges.select("column", (F.col("low") - pad).alias("low"), (F.col("high") + pad).alias("high")), "ranges"
    )
    width = (F.col("high") - F.col("low")) / bins
    return (
        values.join(ranges, "column")
        .groupBy("column", "low", "high", *by, _bin(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
        .select("column", *by, "bin", (F.col("low") + (F.col("bin") - 1) * width).alias("bin_start"), "n")
    )


def price_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(df, ["price"], bins, [TARGET]).drop("column")


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median and sample deviation per column."""
    values = order_stats.melt(df, columns)
    moments = values.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"))
    return moments.join(F.broadcast(order_stats.column_medians(df, columns)), "column", "left")


def value_counts(df: DataFrame, column: str, top: int | None = None, with_null: bool = False) -> DataFrame:
    """Counts per value, highest first; ties by value. ``top`` keeps the first so many."""
    rows = df if with_null else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return counts.limit(top) if top else counts


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per pair of values, one row per pair that occurs."""
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """The same with one column per given value of ``b``."""
    return df.dropna(subset=[a, b]).groupBy(a).pivot(b, list(values)).count().na.fill(0)


def missingness_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and target rate of each column when it is missing and when it is present."""
    flags = df.select(TARGET, *[F.col(c).isNull().alias(c) for c in columns])
    return (
        flags.unpivot([TARGET], list(columns), "column", "missing")
        .groupBy("column", "missing")
        .agg(F.count("*").alias("n"), F.avg(TARGET).alias("no_show_rate"))
    )


def missingness_shift(df: DataFrame, column: str, features: Sequence[str], limit: float = 10.0) -> DataFrame:
    """Mean of other features where ``column`` is present and missing; a large shift is flagged."""
    gap = F.col(column).isNull().alias("gap")
    means = (
        df.select(gap, *[F.col(f).cast("double").alias(f) for f in features])
        .unpivot(["gap"], list(features), "feature", "value")
        .groupBy("feature")
        .agg(
            F.avg(F.when(~F.col("gap"), F.col("value"))).alias("present_mean"),
            F.avg(F.when(F.col("gap"), F.col("value"))).alias("missing_mean"),
        )
    )
    delta = F.try_divide(F.abs(F.col("present_mean") - F.col("missing_mean")), F.col("present_mean")) * 100
    return means.withColumn("diff_pct", delta).withColumn("flagged", F.coalesce(F.col("diff_pct") > limit, F.lit(False)))

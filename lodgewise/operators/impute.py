"""Grouped imputation of rooms and prices, with broader groups as fallback."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgewise.functions.features import price_per_guest
from lodgewise.operators import order_stats
from lodgewise.session import stored
from lodgewise.sources.tables import write_parquet

ROOM_KEYS = ["branch", "total_guests"]
PRICE_KEYS = ["branch", "room"]


def most_common(counts: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The value with the highest count per key; ties go to the smallest value.

    ``counts`` has one row per key and value, so the choice is a plain partial aggregate.
    """
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("value")))["value"]
    return counts.where(F.col(value).isNotNull()).dropna(subset=list(keys)).groupBy(*keys).agg(first.alias(name))


def group_mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most common non-NULL value per key: ``(keys, mode)``."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return most_common(counts, keys, value, "mode")


@dataclass
class ImputationTables:
    """Fill values learnt from one frame; small tables, one row per group."""

    room_by_group: DataFrame
    room_by_branch: DataFrame
    room_overall: DataFrame
    price_by_group: DataFrame | None = None
    price_overall: DataFrame | None = None

    def fill_rooms(self, df: DataFrame) -> DataFrame:
        """Own room, else the mode of (branch, guests), of the branch, of all."""
        filled = _rooms_from_groups(df, self.room_by_group, self.room_by_branch)
        return filled.withColumn("room", F.coalesce("room", self.room_overall.scalar()))

    def fill_prices(self, df: DataFrame) -> DataFrame:
        """Own price, else the median of (branch, room), else the overall median.

        What was derived from the price is derived again.
        """
        names = df.columns
        filled = df.join(self.price_by_group.withColumnRenamed("median", "_median"), PRICE_KEYS, "left")
        filled = filled.withColumn("price", F.coalesce("price", "_median", self.price_overall.scalar()))
        if "price_per_guest" in names:
            filled = filled.withColumn("price_per_guest", price_per_guest(F.col("price"), F.col("total_guests")))
        return filled.select(*names)

    def fill(self, df: DataFrame) -> DataFrame:
        return self.fill_prices(self.fill_rooms(df))

    def save(self, path: str, mode: str = "overwrite") -> None:
        for name, table in vars(self).items():
            if table is not None:
                write_parquet(table, f"{path}/{name}", mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ImputationTables:
        return cls(**{name: spark.read.parquet(f"{path}/{name}") for name in cls.__dataclass_fields__})


def _rooms_from_groups(df: DataFrame, by_group: DataFrame, by_branch: DataFrame) -> DataFrame:
    names = df.columns
    return (
        df.join(by_group.withColumnRenamed("mode", "_group_mode"), ROOM_KEYS, "left")
        .join(by_branch.withColumnRenamed("mode", "_branch_mode"), ["branch"], "left")
        .withColumn("room", F.coalesce("room", "_group_mode", "_branch_mode"))
        .select(*names)
    )


def fit_rooms(df: DataFrame) -> ImputationTables:
    """Room modes at three levels from one pass over the rows.

    Everything is read off the stored counts per (branch, guests, room); the overall mode is taken
    after the narrower fills, which the counts allow as well.
    """
    counts = stored(df.groupBy(*ROOM_KEYS, "room").agg(F.count("*").alias("n")), "rooms")
    by_group = stored(most_common(counts, ROOM_KEYS, "room", "mode"), "modes")
    by_branch = stored(
        most_common(counts.groupBy("branch", "room").agg(F.sum("n").alias("n")), ["branch"], "room", "mode"), "modes"
    )
    filled = _rooms_from_groups(counts, by_group, by_branch).groupBy("room").agg(F.sum("n").alias("n"))
    return ImputationTables(by_group, by_branch, stored(most_common(filled, [], "room", "mode"), "modes"))


def fit_prices(df: DataFrame, tables: ImputationTables) -> ImputationTables:
    """Price medians by (branch, room) and overall, on rows whose rooms are filled.

    The three columns that matter are stored, since both levels pass over them. One histogram per
    group, missing prices included, serves both levels: the overall median counts the group-filled
    rows too, so each group adds its median once with the number of its gaps.
    """
    rows = stored(order_stats.weighted(df, PRICE_KEYS, "price"), "rows")
    counts = stored(order_stats.histogram(rows, PRICE_KEYS), "prices")
    wanted = stored(order_stats.locate(counts, PRICE_KEYS, [0.5]), "places")
    by_group = stored(
        order_stats.pick(rows, wanted, PRICE_KEYS).select(*PRICE_KEYS, F.col("quantile").alias("median")), "medians"
    )
    everything = F.lit(0).alias("all")
    gaps = counts.where(F.col(order_stats.BUCKET).isNull()).select(*PRICE_KEYS, F.col("_w").alias("gaps"))
    filled = order_stats.weighted(gaps.join(by_group, PRICE_KEYS).withColumn("all", F.lit(0)), ["all"], "median", "gaps")
    all_rows = rows.select(everything, "_v", "_w").unionByName(filled)
    all_counts = counts.select(everything, order_stats.BUCKET, "_w").unionByName(order_stats.histogram(filled, ["all"]))
    all_counts = all_counts.groupBy("all", order_stats.BUCKET).agg(F.sum("_w").alias("_w"))
    place = stored(order_stats.locate(all_counts, ["all"], [0.5]), "places")
    overall = stored(order_stats.pick(all_rows, place, ["all"]).select("quantile"), "median")
    tables.price_by_group, tables.price_overall = by_group, overall
    return tables


def fit(df: DataFrame) -> ImputationTables:
    """Learn all fill values in two passes over ``df``."""
    tables = fit_rooms(df)
    return fit_prices(tables.fill_rooms(df), tables)


def impute_rooms(df: DataFrame) -> DataFrame:
    """Fill rooms with modes of the same frame."""
    return fit_rooms(df).fill_rooms(df)


def impute(df: DataFrame) -> DataFrame:
    """Fill rooms, then prices, with statistics of the same frame (``fit_scope='batch'``)."""
    return fit(df).fill(df)


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def _counts(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", name)


def imputation_summary(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column before and after: one row per column."""
    return (
        _counts(before, columns, "before")
        .join(F.broadcast(_counts(after, columns, "after")), "column")
        .select("column", "before", "after", (F.col("before") - F.col("after")).alias("imputed"))
    )


def imputation_shift(before: DataFrame, after: DataFrame, column: str = "price") -> DataFrame:
    """Mean, median and sample deviation of a column in both frames."""
    tagged = before.select(F.lit("before").alias("stage"), column).unionByName(
        after.select(F.lit("after").alias("stage"), column)
    )
    moments = tagged.groupBy("stage").agg(F.avg(column).alias("mean"), F.stddev(column).alias("std"))
    return moments.join(F.broadcast(order_stats.exact_medians(tagged, ["stage"], column)), "stage")


def fill_constant(df: DataFrame, columns: Sequence[str], value: str = "missing") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in columns})

"""Feature expressions on cleaned bookings; one projection, no shuffle."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgewise.functions.clean import clean_bookings
from lodgewise.schema import USD_TO_SGD

# Days per month with a 29-day February, and the default for an unknown month.
MONTH_DAYS = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
UNKNOWN_MONTH_DAYS = 30

_YEAR_DAYS = sum(MONTH_DAYS)
_DAYS_BEFORE = list(accumulate(MONTH_DAYS, initial=0))[:12]


def _by_month(values: list[int], m: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), m - 1)


def days_in_month(m: Column) -> Column:
    return F.coalesce(_by_month(MONTH_DAYS, m), F.lit(UNKNOWN_MONTH_DAYS))


def stay_length(arrival_month: Column, arrival_day: Column, checkout_month: Column, checkout_day: Column) -> Column:
    """Nights between two month/day pairs without a year; at least 1, NULL if a month is unknown.

    Walking the months from arrival to checkout is the distance between both places in the year,
    taken modulo the length of the year.
    """
    gap = F.pmod(_by_month(_DAYS_BEFORE, checkout_month) - _by_month(_DAYS_BEFORE, arrival_month), F.lit(_YEAR_DAYS))
    nights = F.greatest(F.lit(1), gap + checkout_day - arrival_day)
    return F.when(gap.isNotNull(), nights)


def lead_time(booking_month: Column, arrival_month: Column) -> Column:
    return F.pmod(arrival_month - booking_month, F.lit(12))


def cyclical(value: Column, period: Column | float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / period
    return F.sin(angle), F.cos(angle)


def price_per_guest(price: Column, total_guests: Column) -> Column:
    return price / F.nullif(total_guests, F.lit(0))


def add_features(df: DataFrame) -> DataFrame:
    """Derived columns of cleaned (and, if wanted, imputed) bookings."""
    c = F.col
    total = c("num_adults") + c("num_children")
    out = {
        "stay_length": stay_length(c("arrival_month"), c("arrival_day"), c("checkout_month"), c("checkout_day")),
        "lead_time_months": lead_time(c("booking_month"), c("arrival_month")),
        "total_guests": total,
        "price_per_guest": price_per_guest(c("price"), total),
    }
    for name in ("arrival_month", "booking_month"):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclical(c(name), 12)
    for side in ("arrival", "checkout"):
        sin, cos = cyclical(c(f"{side}_day"), days_in_month(c(f"{side}_month")))
        out[f"{side}_day_sin"], out[f"{side}_day_cos"] = sin, cos
    return df.withColumns(out)


def engineer(df: DataFrame, rate: float = USD_TO_SGD) -> DataFrame:
    """Clean and derive, leaving gaps as they are."""
    return add_features(clean_bookings(df, rate))


def inferred_month_days(df: DataFrame) -> DataFrame:
    """Longest observed day per month over arrivals and checkouts; 30 for months never seen."""
    arrivals = df.select(F.col("arrival_month").alias("month"), F.col("arrival_day").alias("day"))
    checkouts = df.select(F.col("checkout_month").alias("month"), F.col("checkout_day").alias("day"))
    seen = (
        arrivals.unionByName(checkouts)
        .where("month between 1 and 12")
        .groupBy("month")
        .agg(F.max("day").alias("days"))
    )
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(F.broadcast(seen), "month", "left").select(
        "month", F.coalesce("days", F.lit(UNKNOWN_MONTH_DAYS)).alias("days")
    )

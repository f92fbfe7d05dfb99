import math

from pyspark.sql import functions as F

from lodgewise.functions import features


def nights(arrival_month, arrival_day, checkout_month, checkout_day):
    """Walks day counts month by month."""
    days = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    if arrival_month == checkout_month:
        return max(1, checkout_day - arrival_day)
    total, m = days[arrival_month - 1] - arrival_day, arrival_month % 12 + 1
    while m != checkout_month:
        total += days[m - 1]
        m = m % 12 + 1
    return max(1, total + checkout_day)


def test_stay_length_equals_walking_the_months(spark):
    cases = [(a, d, c, e) for a in range(1, 13) for c in range(1, 13) for d in (1, 14, 28) for e in (1, 15, 28)]
    df = spark.createDataFrame(cases, "a int, d int, c int, e int")
    out = df.select("*", features.stay_length(F.col("a"), F.col("d"), F.col("c"), F.col("e")).alias("n")).collect()
    assert [r["n"] for r in out] == [nights(*r[:4]) for r in out]


def test_stay_over_new_year_and_unknown_month(spark):
    df = spark.createDataFrame([(12, 30, 1, 2), (None, 1, 2, 3)], "a int, d int, c int, e int")
    out = df.select(features.stay_length(F.col("a"), F.col("d"), F.col("c"), F.col("e"))).collect()
    assert [r[0] for r in out] == [3, None]


def test_days_in_month(spark):
    df = spark.createDataFrame([(2,), (4,), (12,), (0,), (13,), (None,)], "m int")
    assert [r[0] for r in df.select(features.days_in_month(F.col("m"))).collect()] == [29, 30, 31, 30, 30, 30]


def test_engineered_columns(clean_bookings):
    for r in features.engineer(clean_bookings).limit(50).collect():
        assert r["lead_time_months"] == (r["arrival_month"] - r["booking_month"]) % 12
        assert r["total_guests"] == r["num_adults"] + r["num_children"]
        assert math.isclose(r["price_per_guest"], r["price"] / r["total_guests"])
        assert math.isclose(r["arrival_month_sin"], math.sin(2 * math.pi * r["arrival_month"] / 12), abs_tol=1e-12)
        assert math.isclose(r["checkout_day_sin"] ** 2 + r["checkout_day_cos"] ** 2, 1.0)


def test_no_guests_means_no_price_per_guest(spark):
    df = spark.createDataFrame([(100.0, 0), (100.0, 4)], "p double, n int")
    assert [r[0] for r in df.select(features.price_per_guest(F.col("p"), F.col("n"))).collect()] == [None, 25.0]


def test_inferred_days_default_to_thirty(spark):
    df = spark.createDataFrame([(1, 20, 2, 27), (1, 31, 1, 3)], "arrival_month int, arrival_day int, checkout_month int, checkout_day int")
    days = {r["month"]: r["days"] for r in features.inferred_month_days(df).collect()}
    assert days == {1: 31, 2: 27, **{m: 30 for m in range(3, 13)}}

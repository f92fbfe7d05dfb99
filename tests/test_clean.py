from pyspark.sql import functions as F

from lodgewise.functions import clean
from lodgewise.schema import BOOKING_DDL


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def test_numbers_that_are_not_numbers_become_null(spark):
    texts = ["12", " 1.5 ", "1e3", "-.5", "two", "", "nan", "1d", "0x1p3", "Infinity", None]
    assert values(spark, texts, clean.to_number) == [12.0, 1.5, 1000.0, -0.5] + [None] * 7


def test_month_from_number_or_name_in_any_case(spark):
    texts = ["7", "7.0", "JANUARY", " december ", "mArCh", "Juno", "", None]
    assert values(spark, texts, clean.month) == [7, 7, 1, 12, 3, None, None, None]


def test_currency_defaults_to_sgd(spark):
    assert values(spark, ["SGD$ 1", "USD$ 2", "usd$ 3", "4", None], clean.currency) == ["SGD", "USD", "usd", "SGD", "SGD"]


def test_amount_strips_upper_case_prefix_and_commas(spark):
    texts = ["SGD$ 1,234.50", "USD$665.37", "99", "usd$ 5", "free", None]
    assert values(spark, texts, clean.amount) == [1234.5, 665.37, 99.0, None, None, None]


def test_guest_words(spark):
    texts = ["one", "Two", "TEN", "3", "2.0", "eleven", None]
    assert values(spark, texts, clean.guests) == [1, 2, 10, 3, 2, 0, 0]


def test_first_time_flags(spark):
    texts = ["Yes", "No", "1", "0", "maybe", None]
    assert values(spark, texts, clean.flag) == [1, 0, 1, 0, 0, 0]
    assert values(spark, texts, clean.yes_no) == [1, 0, None, None, None, None]


def test_sql_price_idiom(spark):
    assert values(spark, ["SGD$ 12.5", "USD$ 3", "x"], clean.sql_price) == [12.5, 3.0, None]


def test_clean_bookings_converts_once(spark):
    row = (1, 1, "Changi", "May", "JUNE", 3, "6", -9, "Japan", "Yes", None, "USD$ 1,000.00", "Agent", "two", "one")
    df = spark.createDataFrame([row], BOOKING_DDL)
    out = clean.clean_bookings(df, rate=1.5).first()
    assert (out["booking_month"], out["arrival_month"], out["checkout_month"]) == (5, 6, 6)
    assert (out["price"], out["currency"], out["checkout_day"]) == (1500.0, "SGD", 9)
    assert (out["first_time"], out["num_adults"], out["num_children"], out["room"]) == (1, 2, 1, None)


def test_clean_bookings_keeps_typed_columns(clean_bookings):
    before = clean_bookings.select("booking_id", "price", "num_adults", "arrival_month", "first_time").collect()
    after = clean.clean_bookings(clean_bookings).select(*before[0].asDict()).collect()
    assert sorted(before) == sorted(after)

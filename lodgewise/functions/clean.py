"""Column expressions that turn dirty booking fields into typed values.

Bad input becomes NULL (or the documented default); nothing here raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgewise.schema import USD_TO_SGD

# Month names and number words, position = value.
MONTH_NAMES = [
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]

# How a price names its currency, and what precedes the amount.
CURRENCY_PATTERN = r"^(\w+)\$"
CURRENCY_PREFIX = r"^[A-Z]+\$\s*"
DEFAULT_CURRENCY = "SGD"

# Plain decimal notation. Java would also parse "1d", "0x1p3" and "NaN", which are not numbers here.
_DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _position(words: list[str], c: Column) -> Column:
    """1-based place of lower-case text in ``words``; NULL if it is not one of them."""
    entries = [F.lit(x) for i, word in enumerate(words, start=1) for x in (word.lower(), i)]
    return F.element_at(F.create_map(*entries), c)


def to_number(c: Column) -> Column:
    """Text to double; whatever is not a decimal number is NULL."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """A column as double: numeric columns skip the text round trip."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        c = F.col(name).cast("double")
        return F.when(~F.isnan(c), c)
    return to_number(F.col(name))


def month(c: Column) -> Column:
    """Month number from 1..12 or an English month name in any case."""
    text = c.cast("string")
    return F.coalesce(_position(MONTH_NAMES, F.lower(F.trim(text))), to_number(text).try_cast("int"))


def month_name(c: Column) -> Column:
    """Month text in title case, as the profile shows it."""
    return F.initcap(c)


def currency(c: Column) -> Column:
    found = F.regexp_extract(c.cast("string"), CURRENCY_PATTERN, 1)
    return F.when(found != "", found).otherwise(DEFAULT_CURRENCY)


def amount(c: Column) -> Column:
    """The number in a price text, in the currency it names."""
    return to_number(F.replace(F.regexp_replace(c.cast("string"), CURRENCY_PREFIX, ""), F.lit(","), F.lit("")))


def to_sgd(value: Column, code: Column, rate: float = USD_TO_SGD) -> Column:
    return F.when(F.upper(code) == "USD", value * F.lit(rate)).otherwise(value)


def yes_no(c: Column) -> Column:
    """Yes 1, No 0, anything else NULL."""
    return F.when(c == "Yes", 1).when(c == "No", 0)


def flag(c: Column) -> Column:
    """0/1 from a number or Yes/No; unknown counts as 0."""
    text = c.cast("string")
    return F.coalesce(to_number(text).try_cast("int"), yes_no(text), F.lit(0))


def guests(c: Column) -> Column:
    """A head count from a number or a number word; unknown counts as 0."""
    text = c.cast("string")
    return F.coalesce(
        _position(NUMBER_WORDS, F.lower(text)), to_number(text).try_cast("int"), F.lit(0)
    )


def sql_price(c: Column) -> Column:
    """The price idiom of ad-hoc SQL: both known prefixes removed, then cast."""
    bare = F.replace(F.replace(c, F.lit("SGD$ "), F.lit("")), F.lit("USD$ "), F.lit(""))
    return bare.try_cast("double")


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def clean_bookings(df: DataFrame, rate: float = USD_TO_SGD) -> DataFrame:
    """Every cleaning rule at once, as projections over the scan.

    Columns that arrive as numbers are taken as they are. The currency is a column of its own before
    it is used, so that the pattern runs once per row and the generated code stays small enough for
    the JVM to compile.
    """
    have = set(df.columns)
    out: dict[str, Column] = {}
    for name in ("booking_month", "arrival_month", "checkout_month"):
        if name in have:
            out[name] = F.col(name).try_cast("int") if _numeric(df, name) else month(F.col(name))
    if "first_time" in have:
        c = F.col("first_time")
        out["first_time"] = F.coalesce(c.try_cast("int"), F.lit(0)) if _numeric(df, "first_time") else flag(c)
    if "checkout_day" in have:
        out["checkout_day"] = F.abs(F.col("checkout_day"))
    for name in ("num_adults", "num_children"):
        if name in have:
            c = F.col(name)
            out[name] = F.coalesce(number(df, name).try_cast("int"), F.lit(0)) if _numeric(df, name) else guests(c)
    if "price" not in have:
        return df.withColumns(out)
    if _numeric(df, "price"):
        return df.withColumns({**out, "price": number(df, "price"), "currency": F.lit(DEFAULT_CURRENCY)})
    priced = df.withColumns({**out, "currency": currency(F.col("price")), "price": amount(F.col("price"))})
    code = F.col("currency")
    return priced.withColumns(
        {
            "price": to_sgd(F.col("price"), code, rate),
            "currency": F.when(F.upper(code) == "USD", DEFAULT_CURRENCY).otherwise(code),
        }
    )

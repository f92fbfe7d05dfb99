"""The dirty ``bookings`` relation derived from order tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgewise.sources.tables import parquet_table


def bookings(spark: SparkSession, folder: str) -> DataFrame:
    """One booking per order that has lines.

    Lines are reduced to one row per order before they meet the orders, and the customer side
    (nation, first order) is one row per customer, so no join multiplies rows.
    """
    orders = parquet_table(spark, folder, "orders")
    lines = (
        parquet_table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"), F.count("*").alias("n"))
    )
    first = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("fk"))
    nation = parquet_table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customer = (
        parquet_table(spark, folder, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(nation, "c_nationkey")
        .join(first, "c_custkey")
        .withColumnRenamed("c_custkey", "o_custkey")
    )
    k = F.col("o_orderkey")
    return (
        orders.join(lines, "o_orderkey")
        .join(customer, "o_custkey")
        .select(
            k.alias("booking_id"),
            F.when(k % 97 == 0, None)
            .when(((F.col("o_totalprice") > 300000) & (F.col("n") <= 4)) | (k % 10 == 3), 1)
            .otherwise(0)
            .cast("int")
            .alias("no_show"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Changi").otherwise("Orchard").alias("branch"),
            F.month("o_orderdate").alias("booking_month"),
            F.when(k % 2 == 1, F.upper(F.date_format("s", "MMMM")))
            .otherwise(F.date_format("s", "MMMM"))
            .alias("arrival_month"),
            F.dayofmonth("s").alias("arrival_day"),
            F.date_format("e", "MMMM").alias("checkout_month"),
            F.when(k % 53 == 0, -F.dayofmonth("e")).otherwise(F.dayofmonth("e")).alias("checkout_day"),
            F.col("n_name").alias("country"),
            F.when(k == F.col("fk"), "Yes").otherwise("No").alias("first_time"),
            F.when(k % 11 < 2, None)
            .when(F.col("o_orderpriority") == "1-URGENT", "President Suite")
            .when(F.col("o_orderpriority") == "2-HIGH", "King")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Queen")
            .otherwise("Single")
            .alias("room"),
            F.when(k % 5 == 0, None)
            .otherwise(
                F.concat(
                    F.when(k % 5 == 1, "USD$ ").otherwise("SGD$ "),
                    F.col("o_totalprice").cast("decimal(12,2)").cast("string"),
                )
            )
            .alias("price"),
            F.when(k % 4 == 3, "Phone")
            .when(F.col("o_orderstatus") == "F", "Website")
            .when(F.col("o_orderstatus") == "O", "Agent")
            .otherwise("Email")
            .alias("platform"),
            F.when(k % 6 == 0, "one")
            .when(k % 6 == 1, "two")
            .otherwise((k % 3 + 1).cast("string"))
            .alias("num_adults"),
            (k % 4).cast("double").alias("num_children"),
        )
    )

"""The ten sample questions as direct queries over clean bookings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.functions.columns import exact_mean
from roomledger.operators import insights as I


def revenue_of_month(df: DataFrame, year: int, month: int) -> DataFrame:
    in_month = (F.year("arrival_date") == year) & (F.month("arrival_date") == month)
    return df.where(in_month).agg(F.coalesce(F.sum("total_revenue"), F.lit(0)).cast("double").alias("revenue"))


def cancellations_by_country(df: DataFrame, n: int = 10) -> DataFrame:
    counted = df.where(F.col("country").isNotNull()).groupBy("country").agg(F.sum("is_canceled").alias("canceled"))
    return counted.orderBy(F.desc("canceled"), F.asc("country")).limit(n)


def average_booking_price(df: DataFrame) -> DataFrame:
    return df.agg(exact_mean(F.sum("adr"), F.count("adr")).alias("avg_adr"))


def cancellation_rate_of_hotel(df: DataFrame, hotel: str) -> DataFrame:
    return I.cancellation_by_hotel(df.where(F.col("hotel") == hotel))


def top_segment_by_bookings(df: DataFrame) -> DataFrame:
    return I.booking_channel_percentage(df).orderBy(F.desc("booking_pct"), F.asc("market_segment")).limit(1)


def top_segment_by_cancellation(df: DataFrame) -> DataFrame:
    return I.cancellation_by_channel(df).orderBy(F.desc("cancellation_rate"), F.asc("market_segment")).limit(1)


def monthly_revenue_trend(df: DataFrame) -> DataFrame:
    return I.monthly_revenue(df).orderBy("month_end")


def lead_time_and_cancellation(df: DataFrame) -> DataFrame:
    return I.cancellation_by_lead_time(df).orderBy("bin_no")


def top_customer_type_by_revenue(df: DataFrame) -> DataFrame:
    totals = df.where(F.col("customer_type").isNotNull()).groupBy("customer_type").agg(
        F.coalesce(F.sum("total_revenue"), F.lit(0)).cast("double").alias("revenue")
    )
    return totals.orderBy(F.desc("revenue"), F.asc("customer_type")).limit(1)


def average_stay_of_hotel(df: DataFrame, hotel: str) -> DataFrame:
    return df.where(F.col("hotel") == hotel).agg(
        exact_mean(F.sum("total_stays"), F.count("total_stays")).alias("avg_nights")
    )

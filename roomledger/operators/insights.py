"""The thirteen insights over clean bookings, one by one and all from a single pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomledger import schema
from roomledger.functions import columns as X
from roomledger.operators import describe as D
from roomledger.session import literal_table, materialize

# ---- one insight at a time ----


def mean_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Mean of a column per key; rows without a key are left out."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(X.exact_mean(F.sum(value), F.count(value)).alias(name))
    )


def fill_month_gaps(monthly: DataFrame, value: str) -> DataFrame:
    """Add the months without rows between the first and the last month, with value 0.

    Each month emits itself and the gap up to the next one. The window holds one row per calendar
    month, at most 120,000 over the years a date can have.
    """
    following = F.lead("month").over(Window.orderBy("month"))
    until = F.coalesce(F.add_months("following", -1), F.col("month"))
    months = F.explode(F.sequence("month", until, F.expr("interval 1 month")))
    return (
        monthly.withColumn("following", following)
        .select("month", value, months.alias("each"))
        .select(
            F.col("each").alias("month"),
            F.when(F.col("each") == F.col("month"), F.coalesce(F.col(value), F.lit(0))).otherwise(0).alias(value),
        )
    )


def monthly_revenue(df: DataFrame) -> DataFrame:
    monthly = (
        df.where(F.col("arrival_date").isNotNull())
        .groupBy(F.trunc("arrival_date", "month").alias("month"))
        .agg(F.sum("total_revenue").alias("revenue"))
    )
    return fill_month_gaps(monthly, "revenue").select(
        X.month_end_label(F.col("month")).alias("month_end"), F.col("revenue").cast("double").alias("revenue")
    )


def revenue_by_hotel(df: DataFrame) -> DataFrame:
    return mean_by(df, "hotel", "total_revenue", "avg_revenue")


def revenue_by_room(df: DataFrame) -> DataFrame:
    return mean_by(df, "reserved_room_type", "total_revenue", "avg_revenue")


def revenue_by_segment(df: DataFrame) -> DataFrame:
    return mean_by(df, "market_segment", "total_revenue", "avg_revenue")


def percentage(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def overall_cancellation_rate(df: DataFrame) -> DataFrame:
    """Canceled bookings as a percentage of all rows."""
    canceled = F.coalesce(F.sum("is_canceled"), F.lit(0))
    return df.agg(percentage(canceled, F.count(F.lit(1))).alias("cancellation_pct"))


def cancellation_by_hotel(df: DataFrame) -> DataFrame:
    return mean_by(df, "hotel", "is_canceled", "cancellation_rate")


def cancellation_by_channel(df: DataFrame) -> DataFrame:
    return mean_by(df, "market_segment", "is_canceled", "cancellation_rate")


def _bin_labels(df: DataFrame) -> DataFrame:
    labels = list(schema.LEAD_TIME_LABELS)
    rows = literal_table(df.sparkSession, bin_no=list(range(len(labels))), lead_time_bin=labels)
    return rows.withColumn("bin_no", F.col("bin_no").cast("int"))


def cancellation_by_lead_time(df: DataFrame) -> DataFrame:
    """Cancellation rate per lead-time bin; bins without bookings appear with NULL."""
    rates = mean_by(df, "lead_time_bin", "is_canceled", "cancellation_rate")
    return _bin_labels(df).join(rates, "lead_time_bin", "left").select("bin_no", "lead_time_bin", "cancellation_rate")


def top_countries(df: DataFrame, n: int = schema.TOP_COUNTRIES) -> DataFrame:
    counted = df.where(F.col("country").isNotNull()).groupBy("country").agg(F.count("hotel").alias("bookings"))
    return counted.orderBy(F.desc("bookings"), F.asc("country")).limit(n)


def lead_time_stats(df: DataFrame) -> DataFrame:
    return D.describe_column(df, "lead_time")


def length_of_stay_stats(df: DataFrame) -> DataFrame:
    return D.describe_column(df, "total_stays")


def booking_channel_percentage(df: DataFrame) -> DataFrame:
    """Share of each market segment in the bookings that have one.

    Counts are written once: the total and the shares both read them.
    """
    counts = materialize(
        df.where(F.col("market_segment").isNotNull()).groupBy("market_segment").agg(F.count("hotel").alias("n"))
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("market_segment", percentage(F.col("n"), total).alias("booking_pct"))


def adr_by_customer_type(df: DataFrame) -> DataFrame:
    return mean_by(df, "customer_type", "adr", "avg_adr")


def lead_time_histogram(df: DataFrame, bins: int = schema.HISTOGRAM_BINS) -> DataFrame:
    return D.histogram_of_column(df, "lead_time", bins)


# ---- all insights from one pass ----

# Rollup dimension -> column it groups by.
DIMENSIONS = {
    "month": "month",
    "hotel": "hotel",
    "room": "reserved_room_type",
    "segment": "market_segment",
    "country": "country",
    "lead_time": "lead_time",
    "total_stays": "total_stays",
    "customer_type": "customer_type",
}


def booking_rollup(df: DataFrame) -> DataFrame:
    """Counts and sums per value of every report dimension, from one pass over the bookings.

    Result: ``dimension, key, day, bookings, hotels, canceled, canceled_known, revenue,
    revenue_known, adr, adr_known``. ``key`` is the value as text, ``day`` the value of the two
    integer dimensions. Rows are aggregated within each task before the shuffle, so what moves is
    one row per value and task. A NULL key stays: each dimension covers all bookings.
    """
    names, keys = list(DIMENSIONS), list(DIMENSIONS.values())
    grouped = (
        df.withColumn("month", F.trunc("arrival_date", "month"))
        .groupingSets([[F.col(k)] for k in keys], *keys)
        .agg(
            F.grouping_id().alias("set"),
            F.count(F.lit(1)).alias("bookings"),
            F.count("hotel").alias("hotels"),
            F.sum("is_canceled").alias("canceled"),
            F.count("is_canceled").alias("canceled_known"),
            F.sum("total_revenue").alias("revenue"),
            F.count("total_revenue").alias("revenue_known"),
            F.sum("adr").alias("adr"),
            F.count("adr").alias("adr_known"),
        )
    )
    # A grouping set with one column leaves that column's bit 0 (the first column has the highest bit).
    all_bits = (1 << len(keys)) - 1
    dimension = F.lit(None).cast("string")
    for i, name in enumerate(names):
        dimension = F.when(F.col("set") == all_bits - (1 << (len(keys) - 1 - i)), F.lit(name)).otherwise(dimension)
    return grouped.select(
        dimension.alias("dimension"),
        F.coalesce(*[F.col(k).cast("string") for k in keys]).alias("key"),
        X.whole_number(F.coalesce("lead_time", "total_stays"), "lead_time or total_stays").alias("day"),
        *grouped.columns[len(keys) + 1 :],
    )


def _entry(category: str, subkey: Column, value: Column) -> Column:
    return F.struct(
        F.lit(category).alias("category"),
        subkey.cast("string").alias("subkey"),
        value.cast("double").alias("value"),
    )


def insights_from_rollup(rollup: DataFrame) -> DataFrame:
    """Long table ``category, subkey, value`` of all thirteen insights.

    Reads the rollup several times, so pass a materialized one.
    """
    key = F.col("key")
    keyed = rollup.where(key.isNotNull())
    revenue = X.exact_mean(F.col("revenue"), F.col("revenue_known"))
    canceled = X.exact_mean(F.col("canceled"), F.col("canceled_known"))
    adr = X.exact_mean(F.col("adr"), F.col("adr_known"))
    means = {
        "hotel": [_entry("revenue_by_hotel", key, revenue), _entry("cancellation_by_hotel", key, canceled)],
        "room": [_entry("revenue_by_room", key, revenue)],
        "segment": [_entry("revenue_by_segment", key, revenue), _entry("cancellation_by_channel", key, canceled)],
        "customer_type": [_entry("adr_by_customer_type", key, adr)],
    }
    entries = F.array().cast(f"array<{schema.INSIGHTS.simpleString()}>")
    for dimension, structs in means.items():
        entries = F.when(F.col("dimension") == dimension, F.array(*structs)).otherwise(entries)
    by_key = keyed.where(F.col("dimension").isin(*means)).select(F.inline(entries))

    monthly = fill_month_gaps(
        keyed.where(F.col("dimension") == "month").select(key.cast("date").alias("month"), "revenue"), "revenue"
    ).select(F.inline(F.array(_entry("monthly_revenue", X.month_end_label(F.col("month")), F.col("revenue")))))

    overall = (
        rollup.where(F.col("dimension") == "hotel")
        .agg(F.coalesce(F.sum("canceled"), F.lit(0)).alias("c"), F.coalesce(F.sum("bookings"), F.lit(0)).alias("n"))
        .select(F.inline(F.array(_entry("overall_cancellation_rate", F.lit(None), percentage(F.col("c"), F.col("n"))))))
    )

    days = keyed.where(F.col("dimension").isin("lead_time", "total_stays"))
    binned = (
        days.where(F.col("dimension") == "lead_time")
        .groupBy(X.bin_label(F.col("day")).alias("lead_time_bin"))
        .agg(X.exact_mean(F.sum("canceled"), F.sum("canceled_known")).alias("rate"))
    )
    by_bin = (
        _bin_labels(rollup)
        .join(binned, "lead_time_bin", "left")
        .select(F.inline(F.array(_entry("cancellation_by_lead_time", F.col("lead_time_bin"), F.col("rate")))))
    )

    countries = (
        keyed.where(F.col("dimension") == "country")
        .orderBy(F.desc("hotels"), F.asc("key"))
        .limit(schema.TOP_COUNTRIES)
        .select(F.inline(F.array(_entry("top_countries", key, F.col("hotels")))))
    )

    stats_name = F.when(F.col("dimension") == "lead_time", "lead_time_stats").otherwise("length_of_stay_stats")
    stats = D.describe(
        days.select("dimension", F.col("day").alias("days"), F.col("bookings").alias("n")),
        ["lead_time", "total_stays"],
    ).select(stats_name.alias("category"), "subkey", "value")

    segments = keyed.where(F.col("dimension") == "segment")
    total = segments.agg(F.sum("hotels")).scalar()
    shares = segments.select(
        F.inline(F.array(_entry("booking_channel_percentage", key, percentage(F.col("hotels"), total))))
    )

    parts = [by_key, monthly, overall, by_bin, countries, stats, shares]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    return long


def insights_long(df: DataFrame) -> DataFrame:
    """All insights of clean bookings; the only pass over them is the rollup."""
    return insights_from_rollup(materialize(booking_rollup(df)))


def category_number(category: Column) -> Column:
    """Place of a category in the report."""
    return F.array_position(F.lit(list(schema.CATEGORIES)), category).cast("int")

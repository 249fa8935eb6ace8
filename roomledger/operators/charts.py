"""The series behind the five charts, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.operators import describe as D
from roomledger.operators import insights as I

# Chart name -> insight it draws. The fifth chart is the lead-time histogram.
SERIES = {
    "monthly_revenue": "monthly_revenue",
    "cancellation_by_hotel": "cancellation_by_hotel",
    "top_countries": "top_countries",
    "adr_by_customer": "adr_by_customer_type",
}
HISTOGRAM = "lead_time_distribution"


def chart_series(rollup: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """Long table ``chart, label, value`` of all five charts, from the materialized rollup.

    ``insights``: those of the rollup, where they are stored already. Labels of the histogram are bin numbers; :func:`lead_time_bins` has the edges.
    """
    names = F.create_map(*[F.lit(x) for chart, insight in SERIES.items() for x in (insight, chart)])
    insights = I.insights_from_rollup(rollup) if insights is None else insights
    bars = insights.where(F.col("category").isin(*SERIES.values())).select(
        F.element_at(names, F.col("category")).alias("chart"), F.col("subkey").alias("label"), "value"
    )
    bins = lead_time_bins(rollup).select(
        F.lit(HISTOGRAM).alias("chart"), F.col("bin").cast("string").alias("label"), F.col("count").cast("double").alias("value")
    )
    return bars.unionByName(bins)


def lead_time_bins(rollup: DataFrame) -> DataFrame:
    """Histogram of lead times without another pass over the bookings."""
    days = rollup.where((F.col("dimension") == "lead_time") & F.col("day").isNotNull())
    return D.histogram(days.select("dimension", F.col("day").alias("days"), F.col("bookings").alias("n")))

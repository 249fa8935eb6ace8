"""Response times and the evaluation report over a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.functions import columns as X


def response_times(log: DataFrame) -> DataFrame:
    """Add ``response_time`` in seconds from ``started_at`` and ``ended_at``."""
    micros = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    return log.withColumn("response_time", micros / F.lit(1_000_000.0))


def average_response_time(times: DataFrame) -> DataFrame:
    """Mean response time over all requests in seconds, 0 if there are none."""
    mean = F.coalesce(F.avg("response_time"), F.lit(0.0))
    return times.agg(mean.alias("average_response_time"), F.count(F.lit(1)).alias("questions"))


def evaluation_report(results: DataFrame) -> DataFrame:
    """Report lines from ``question_number, question, answer, graph, response_time``."""
    return results.select(
        "question_number",
        "question",
        "answer",
        F.when(F.coalesce("graph", F.lit("")) != "", F.lit("Yes")).otherwise(F.lit("No")).alias("has_graph"),
        X.two_decimals(F.col("response_time")).alias("response_seconds"),
    )

"""Spreading of inputs that Spark can only read in a few tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out to all cores if it has less than half as many splits as cores.

    A file with one row group, or a compressed CSV file, is one task however long. Rows are dealt
    by their position in the scan, so equal rows and hot keys do not gather and a repeated task
    deals the same way. A scan with enough splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, F.monotonically_increasing_id())

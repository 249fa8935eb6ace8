"""Chart images from a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_charts(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of the PNG files in a folder; other files are not opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path", "content")

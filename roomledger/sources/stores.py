"""Insights as JSON, documents with their vectors as Parquet in versions. Writing twice replaces."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from roomledger import schema
from roomledger.session import literal_table


def insights_as_json(insights: DataFrame) -> DataFrame:
    """One JSON object per insight value: ``category``, ``subkey`` (null for a single number) and ``value``.

    The layout is the same for any number of values, and no category is gathered in one task. A missing
    value is ``null``.
    """
    row = F.struct("category", "subkey", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    return insights.select("category", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def save_insights(insights: DataFrame, path: str) -> str:
    insights_as_json(insights).select("json").write.mode("overwrite").text(path)
    return path


def load_insights(spark: SparkSession, path: str) -> DataFrame:
    """Saved insights as the long table ``category, subkey, value``."""
    return spark.read.schema("category string, subkey string, value double").json(path)


def flat_documents(documents: DataFrame) -> DataFrame:
    """Documents with the entries of ``metadata`` as columns, so that a reader of one entry reads only that.

    Already flat documents stay as they are; entries that ``schema.DOCUMENTS`` doesn't name are not kept.
    """
    if "metadata" not in documents.columns:
        return documents
    names = [f.name for f in schema.DOCUMENTS if f.name not in ("doc_id", "page_content")]
    others = [c for c in documents.columns if c not in ("doc_id", "page_content", "metadata", *names)]
    return documents.select("doc_id", "page_content", *(F.col("metadata").getItem(n).alias(n) for n in names), *others)


def with_metadata(documents: DataFrame) -> DataFrame:
    """Stored documents with ``metadata`` as a map again, for display."""
    names = [f.name for f in schema.DOCUMENTS if f.name in documents.columns and f.name not in ("doc_id", "page_content")]
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names)), lambda e: e["value"].isNotNull())
    return documents.withColumn("metadata", F.map_from_entries(entries)).drop(*names)


def save_documents(documents: DataFrame, path: str) -> str:
    """A new version of the store, whole or not at all.

    Each version is a folder of its own; once it is written, one small row in ``pointers`` names it. A reader sees
    the version before until then, and for good if the write fails. Older versions stay for readers that still
    use them; :func:`unused_versions` lists what may be removed.
    """
    path = path.rstrip("/")
    spark, before = documents.sparkSession, _pointers(documents.sparkSession, path)
    version = f"version-{uuid.uuid4().hex}"
    flat_documents(documents).write.parquet(f"{path}/{version}")
    number = 1 + max((p["number"] for p in before or []), default=0)
    pointer = literal_table(spark, number=[number], version=[version])
    pointer.coalesce(1).write.mode("append").json(f"{path}/pointers")
    return path


def _pointers(spark: SparkSession, path: str) -> list[Row] | None:
    """All pointers of a store, one small row for each time it was written, the current one last; None without any."""
    try:
        rows = spark.read.schema("number long, version string").json(f"{path}/pointers")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return sorted(rows.collect()) or None


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a store, or a plain Parquet folder of documents."""
    path = path.rstrip("/")
    pointers = _pointers(spark, path)
    return spark.read.parquet(path if pointers is None else f"{path}/{pointers[-1]['version']}")


def unused_versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of versions before the current one, oldest first."""
    path = path.rstrip("/")
    return [f"{path}/{p['version']}" for p in (_pointers(spark, path) or [])[:-1]]

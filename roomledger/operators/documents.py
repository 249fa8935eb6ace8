"""Insights and charts as one-line text documents, and their embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger import schema
from roomledger.functions import columns as X
from roomledger.functions.vectors import Embedder, hashed_words
from roomledger.session import literal_table

_TEXT_MAP = "map<string,string>"


def _doc_id(*parts: Column) -> Column:
    """Readable key that depends only on what the document is about."""
    return F.concat_ws("/", *parts)


def insight_documents(insights: DataFrame) -> DataFrame:
    """One line of text per insight value; a value that is missing reads ``nan``."""
    category, subkey = F.col("category"), F.col("subkey")
    text = X.insight_value_text(category, subkey, F.col("value"))
    label = F.when(subkey.isNull(), category).otherwise(F.concat(category, F.lit(" - "), subkey))
    metadata = F.when(subkey.isNull(), F.create_map(F.lit("category"), category)).otherwise(
        F.create_map(F.lit("category"), category, F.lit("subkey"), subkey)
    )
    return insights.select(
        _doc_id(F.lit("insight"), category, subkey).alias("doc_id"),
        F.concat(label, F.lit(": "), text).alias("page_content"),
        metadata.cast(_TEXT_MAP).alias("metadata"),
    )


def description_documents(spark: SparkSession) -> DataFrame:
    rows = literal_table(
        spark,
        category=[category for category, _ in schema.DESCRIPTIONS],
        page_content=[text for _, text in schema.DESCRIPTIONS],
    )
    return rows.select(
        _doc_id(F.lit("description"), F.col("category")).alias("doc_id"),
        "page_content",
        F.create_map(F.lit("category"), F.col("category")).cast(_TEXT_MAP).alias("metadata"),
    )


def graph_documents(files: DataFrame) -> DataFrame:
    """One document per chart file, from a frame with ``path`` and ``content`` (see ``sources``)."""
    file_name = F.element_at(F.split("path", "/"), -1)
    name = F.substring_index(file_name, ".", 1)
    known = F.create_map(*[F.lit(x) for pair in schema.CHART_DESCRIPTIONS.items() for x in pair])
    other = F.concat(F.lit("Graph showing data for "), F.replace(F.col("name"), F.lit("_"), F.lit(" ")), F.lit("."))
    return (
        files.where(file_name.endswith(".png"))
        .select("path", name.alias("name"), X.base64_text(F.col("content")).alias("image"))
        .withColumn("description", F.coalesce(F.try_element_at(known, F.col("name")), other))
        .select(
            _doc_id(F.lit("graph"), F.col("path")).alias("doc_id"),
            F.concat(F.lit("Graph: "), F.col("name"), F.lit(" - "), F.col("description")).alias("page_content"),
            F.create_map(
                F.lit("type"), F.lit("graph"),
                F.lit("image_base64"), F.col("image"),
                F.lit("graph_name"), F.col("name"),
                F.lit("description"), F.col("description"),
            ).cast(_TEXT_MAP).alias("metadata"),
        )
    )


def all_documents(insights: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Insight, description and chart documents in one table."""
    documents = insight_documents(insights).unionByName(description_documents(insights.sparkSession))
    return documents if files is None else documents.unionByName(graph_documents(files))


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, output: str = "embedding") -> DataFrame:
    """Add a vector per row. ``embedder`` maps a text column to an ``array<float>`` column.

    Any vectorized UDF fits, such as one around a sentence model; the default compares words.
    """
    return df.withColumn(output, (embedder or hashed_words())(F.col(text)))

"""Queries over the test tables, one for each operator, and their SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import (
    boilerplate,
    centroids,
    decontamination,
    divergence,
    language,
    licenses,
    secret_scan,
    sentencepiece_fst,
    sharding,
    simhash,
    tool_calls,
    topk,
    toxicity,
)
from roomledger.llm.common import table

SHARDS = tuple(f"shard-{i:03d}" for i in range(256))
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents").select("doc_id"), "doc_id", SHARDS)


def op2_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return sentencepiece_fst.tokenized(documents, sentencepiece_fst.read_model(spark, f"file://{TOKENIZER}")).drop("text")


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    told = language.identify(documents.select("doc_id", "text"), language.learn(documents))
    return told.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_tool_call_linking(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "conversations")
    calls, results = tool_calls.dialogue_calls(messages)
    calls, results = calls.unionByName(tool_calls.calls_in(messages)), results.unionByName(tool_calls.results_in(messages))
    return tool_calls.formatted(calls, results, tool_calls.schema_table(spark, tool_calls.REPLY))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.findings(table(spark, folder, "documents"))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_text(table(spark, folder, "pages"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.rated(documents, toxicity.train(documents, labels, evidence_grades=3)).drop("text")


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return licenses.labelled(licenses.scan(documents)).select(*columns)


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.with_inertia(*centroids.clusters(table(spark, folder, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_exact_top_k,
        op3_benchmark_decontamination,
        op4_simhash_near_dedup,
        op5_sentencepiece,
        op6_language_id,
        op7_tool_call_linking,
        op8_secret_scan,
        op9_html_extraction,
        op10_toxicity,
        op11_license_scan,
        op12_source_divergence,
        op13_centroid_clustering,
    )
}

ORACLE_SQL = {
    "op2_exact_top_k": topk.ORACLE,
    "op3_benchmark_decontamination": decontamination.ORACLE,
    "op7_tool_call_linking": tool_calls.ORACLE,
    "op11_license_scan": licenses.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_centroid_clustering": centroids.ORACLE,
}

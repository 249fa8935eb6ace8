"""A corpus from raw documents: language, near copies, benchmark items, secrets, tokens.

Each stage reads what the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import decontamination, language, secret_scan, sentencepiece_fst, simhash
from roomledger.llm.common import sent_if_small, table, text_digest
from roomledger.llm.queries import TOKENIZER
from roomledger.session import materialize, scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model doesn't reject; texts without a letter go."""
    told = language.identify(docs.withColumn("__row", F.struct(*docs.columns)).select("text", "__row"), language.learn(docs))
    return told.where(~F.col("rejected")).select("__row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id (then text digest). Only copies go, whatever their id."""
    marked = materialize(simhash.copied_rows(docs).withColumnsRenamed({"doc_id": "__id", "digest": "__of"}))
    keyed = docs.withColumn("__digest", text_digest())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of"))
    kept = keyed.join(marked.where("not first"), same, "left_anti")
    repeated = marked.where("first and n > 1")
    single = kept.join(repeated, same, "left_anti")
    return single.unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__digest"])).drop("__digest")


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item; each row is searched by itself, with an id or without."""
    leaks = materialize(decontamination.contaminated_texts(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("digest", "__leak"))
    keyed = docs.withColumn("__digest", text_digest())
    return keyed.join(sent_if_small(leaks, leaks.count()), F.col("__digest") == F.col("__leak"), "left_anti").drop("__digest")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder in place of each secret."""
    return secret_scan.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the ids of the text, their number, and whether decoding them gives the text back."""
    model = sentencepiece_fst.read_model(spark, f"file://{TOKENIZER}")
    return sentencepiece_fst.tokenized(docs.select("doc_id", "text"), model).drop("text")


STAGES = [
    ("language identification", known_language),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmark_items),
    ("secret scan", without_secrets),
    ("SentencePiece encoding", tokens),
]

#: Language and secrets are decided by trained models, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

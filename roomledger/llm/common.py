"""Helpers that several of these operators share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is sent to all executors only if it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 500_000

#: What separates words where case and punctuation don't count.
WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def sent_if_small(side: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows allow it; otherwise Spark shuffles both sides."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def plain_words(text: Column) -> Column:
    """Words in lower case without punctuation; none for NULL."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def text_digest() -> Column:
    """128 bits of ``text``; with ``doc_id`` the key of a row, as ids may be NULL or repeated. Never NULL."""
    return F.coalesce(F.unhex(F.md5(F.col("text").cast("string"))), F.lit(b""))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python workers can import it there.

    The archive is put together in a folder of the driver; Spark hands it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="roomledger-")) / "roomledger.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()

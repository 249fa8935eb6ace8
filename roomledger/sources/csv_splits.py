"""Records of CSV files with line breaks in quoted fields, read in splits.

Spark's own multi-line reading makes a file one task. Here files are read as lines in splits of the usual size. One
pass finds for each split in which state it ends, for either state at its start; a prefix scan over these maps (one
small row a split) tells the true state at each start; a second pass puts records together. Only the pieces of
records that cross the end of a split are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomledger.functions import records as P


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start`` (of the split) and ``value`` of every line, in order within a split."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def states_at_start(states: DataFrame) -> DataFrame:
    """``file, start`` of the splits that start inside a quoted field.

    A split ends in one state whatever it started in, or keeps its state, or turns it. So the state after a split is
    the last fixed one (a file starts with a record), turned as often as splits since then turn it.
    """
    fixed = F.col("from_record") == F.col("from_quote")
    turns = F.when(~fixed & F.col("from_record"), 1).otherwise(0)
    order = Window.partitionBy("file").orderBy("start")
    since = Window.partitionBy("file", "fixed").orderBy("start")
    after = states.withColumn("fixed", F.sum(fixed.cast("int")).over(order)).withColumn(
        "after", (F.coalesce(F.first(F.when(fixed, F.col("from_record")).otherwise(False)).over(since), F.lit(False)).cast("int") + F.sum(turns).over(since)) % 2
    )
    return after.withColumn("before", F.lag("after", 1, 0).over(order)).where("before = 1").select("file", "start")


def records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """``record, header``: the text of every record, with its line breaks; ``header``: it is the first of its file.

    Lines end with ``\\n`` or ``\\r\\n``; empty ones between records are left out. The splits that start inside a field are sent to every executor:
    one small row each, at most one for ``spark.sql.files.maxPartitionBytes`` of input.
    """
    text = lines(spark, path)
    inside = states_at_start(text.mapInArrow(P.states(separator), P.STATES)).withColumn("inside", F.lit(True))
    told = text.join(F.broadcast(inside), ["file", "start"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    found = told.select("file", "start", "value", "inside").mapInArrow(P.pieces(separator), P.PIECES)
    # A record in pieces starts with a tail of one split and goes on with the heads of the next ones.
    pieces = found.where(F.col("kind") != P.WHOLE)
    order = Window.partitionBy("file").orderBy("start", "kind")
    joined = (
        pieces.withColumn("number", F.sum(F.when(F.col("kind") == P.TAIL, 1).otherwise(0)).over(order))
        .groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"), F.max("header").alias("header"))
        .select("header", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    )
    every = found.where(F.col("kind") == P.WHOLE).select("header", "record").unionByName(joined)
    # Lines were split at \n. A record that ends with \r\n has such line breaks inside too, and they count as \n.
    ended = F.replace(F.left("record", F.length("record") - 1), F.lit("\r\n"), F.lit("\n"))
    whole = F.when(F.col("record").endswith("\r"), ended).otherwise(F.col("record"))
    return every.select("header", whole.alias("record")).where("record <> ''")

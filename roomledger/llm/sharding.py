"""Placement of rows on shards by a lookup table that the shards fill in turns.

Every shard has its own order of preference over the slots of a prime-sized table: a start and a
step, both from hashes of its name. The shards take turns, each claiming its first slot that is still
free, until the table is full. So every shard holds the same number of slots (give or take one), and
adding or removing a shard moves few of the others' slots. A row goes to slot ``hash(key) mod size``.

The table has a fixed size, whatever the data, so it is broadcast and rows are placed without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, and some hundred times the usual number of shards, so that shares differ by under one per cent.
TABLE_SIZE = 65_537


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Index into ``shards`` for each slot; ``size`` is a prime of at least ``len(shards)``.

    The result depends on the set of names only: the turns follow the sorted names. No name: ValueError.
    """
    if not shards or len(set(shards)) != len(shards) or size < len(shards):
        raise ValueError("shards must be one or more different names, no more than the table has slots")
    if size < 2 or any(size % n == 0 for n in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is not a prime, so a shard's steps would not reach every slot")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    start = [xxhash.xxh64_intdigest(name, 1) % size for name in shards]
    step = [xxhash.xxh64_intdigest(name, 2) % (size - 1) + 1 for name in shards]
    owner, claimed = [-1] * size, 0
    while claimed < size:
        for shard in turns:
            slot = start[shard]
            while owner[slot] >= 0:
                slot = (slot + step[shard]) % size
            owner[slot] = shard
            start[shard] = (slot + step[shard]) % size
            claimed += 1
            if claimed == size:
                break
    return np.array(owner, dtype=np.int32)


def slots(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows ``slot``, ``shard``."""
    owner = lookup_table(shards, size)
    return spark.createDataFrame(pd.DataFrame({"slot": np.arange(size, dtype=np.int64), "shard": np.array(shards, dtype=object)[owner]}), "slot long, shard string")


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size).cast("long"))


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Every row with its ``slot`` and ``shard``.

    Equal keys go to one shard, NULL among them: it is hashed like a value. Input columns that are called
    ``slot`` or ``shard`` are replaced. An empty table stays empty.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("slot", "shard") or c == key]
    if key.lower() in ("slot", "shard"):
        raise ValueError("the key must have another name than the columns that are added")
    keyed = rows.select(*kept, slot_of(F.col(f"`{key}`"), size).alias("slot"))
    return keyed.join(F.broadcast(slots(rows.sparkSession, shards, size)), "slot").select(*kept, "slot", "shard")


def shares(placed: DataFrame) -> DataFrame:
    """Rows per shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"))

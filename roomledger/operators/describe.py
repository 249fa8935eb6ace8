"""Exact descriptive statistics: of whole-number columns (days, nights) from value counts, of real ones by rounds.

Whole numbers work on a frequency table ``(dimension, days, n)``: one row per distinct value.
Values are 32-bit integers, so a block of 65,536 neighbouring values bounds both kinds of window
used here: at most 65,536 rows in a block and at most 65,536 blocks in a dimension.

Real numbers may all be distinct, so they are never grouped by value. A double's bits, with those of negative
numbers turned, order like the doubles; each round counts the next ``ROUND_BITS`` of them among the values that
can still be a quartile. A round shuffles and returns at most ``2 ** ROUND_BITS`` rows a wanted rank.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from roomledger import schema
from roomledger.functions.columns import exact_mean, whole_number
from roomledger.session import literal_table, materialize, stored

# Tasks get the Arrow function by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_VALUES = 65_536
ROUND_BITS = 12
QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def value_counts(df: DataFrame, column: str, dimension: str | None = None) -> DataFrame:
    """Frequency table of one column of whole numbers, NULLs left out; a fraction stops the job."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(whole_number(F.col(column), column).alias("days"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(dimension or column).alias("dimension"), "days", "n")
    )


def running_counts(counts: DataFrame) -> DataFrame:
    """Add ``upto``, the number of values not above this one, and ``total``, per dimension."""
    block = F.floor(F.col("days") / F.lit(BLOCK_VALUES)).alias("block")
    blocked = counts.select("dimension", block, "days", "n")
    in_order = Window.partitionBy("dimension").orderBy("block")
    offsets = (
        blocked.groupBy("dimension", "block")
        .agg(F.sum("n").alias("block_n"))
        .select(
            "dimension",
            "block",
            (F.sum("block_n").over(in_order) - F.col("block_n")).alias("before"),
            F.sum("block_n").over(Window.partitionBy("dimension")).alias("total"),
        )
    )
    in_block = Window.partitionBy("dimension", "block").orderBy("days")
    return (
        blocked.withColumn("in_block", F.sum("n").over(in_block))
        .join(offsets, ["dimension", "block"])
        .select("dimension", "days", "n", (F.col("before") + F.col("in_block")).alias("upto"), "total")
    )


def quantile(fraction: float) -> Column:
    """Quantile with linear interpolation, as an aggregate over running counts."""
    position = (F.col("total") - 1) * F.lit(fraction)
    low = F.min(F.when(F.col("upto") > F.floor(position), F.col("days")))
    high = F.min(F.when(F.col("upto") > F.ceil(position), F.col("days")))
    weight = F.max(position - F.floor(position))
    return low + (high - low) * weight


def sample_deviation(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from exact integer sums; NULL for fewer than two values."""
    spread = (n * squares - total * total).cast("double")
    return F.sqrt(F.try_divide(spread, n.cast("double") * (n - 1).cast("double")))


def describe(counts: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Long table ``(dimension, subkey, value)``; a dimension without values has count 0."""
    days, n = F.col("days").cast("decimal(38,0)"), F.col("n").cast("decimal(38,0)")
    stats = (
        running_counts(counts)
        .groupBy("dimension")
        .agg(
            F.max("total").cast("decimal(20,0)").alias("n"),
            F.sum(days * n).alias("sum"),
            F.sum(days * days * n).alias("squares"),
            F.min("days").alias("min"),
            F.max("days").alias("max"),
            *[quantile(p).alias(label) for label, p in QUARTILES.items()],
        )
        .select(
            "dimension",
            F.col("n").alias("count"),
            exact_mean(F.col("sum"), F.col("n")).alias("mean"),
            sample_deviation(F.col("n"), F.col("sum"), F.col("squares")).alias("std"),
            "min",
            *QUARTILES,
            "max",
        )
    )
    long = stats.select(
        "dimension",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("subkey"), F.col(f"`{s}`").cast("double").alias("value"))
                    for s in schema.DESCRIBE_LABELS
                ]
            )
        ).alias("s"),
    ).select("dimension", "s.subkey", "s.value")
    pairs = [(d, s) for d in dimensions for s in schema.DESCRIBE_LABELS]
    labels = literal_table(
        counts.sparkSession, dimension=[d for d, _ in pairs], subkey=[s for _, s in pairs]
    )
    empty = F.when(F.col("subkey") == "count", F.lit(0.0))
    return labels.join(long, ["dimension", "subkey"], "left").select(
        "dimension", "subkey", F.coalesce("value", empty).alias("value")
    )


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of one integer column.

    The table is read once; the frequency table is written, as later steps read it twice. Real numbers (also
    decimals, as doubles): see :func:`describe_real`.
    """
    if _is_real(df, column):
        return describe_real(df, column)
    counts = materialize(value_counts(df, column))
    return describe(counts, [column]).select("subkey", "value")


def _is_real(df: DataFrame, column: str) -> bool:
    kind = df.select(column).schema[0].dataType
    return isinstance(kind, (T.FloatType, T.DoubleType)) or (isinstance(kind, T.DecimalType) and kind.scale > 0)


def real_values(df: DataFrame, column: str) -> DataFrame:
    """``value``: a column as doubles, without missing values and NaN."""
    value = F.col(column).cast("double")
    return df.select((value + 0.0).alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))


@F.arrow_udf(T.LongType())
def order_key(values: pa.Array) -> pa.Array:
    """A whole number for each double that orders as the doubles do."""
    bits = values.to_numpy(zero_copy_only=False).view(np.int64)
    return pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def value_of_key(key: int) -> float:
    bits = key ^ ((key >> 63) & 0x7FFFFFFFFFFFFFFF)
    return float(np.array([bits], dtype=np.int64).view(np.float64)[0])


def keys_at(keys: DataFrame, ranks: Sequence[int]) -> dict[int, int]:
    """The ``key`` at each of some ranks (from 0) in ascending order; ``keys`` is read once a round."""
    shift, inside = 64, {rank: (0, rank) for rank in ranks}  # rank -> bits known so far, rank among the keys with them
    while shift and inside:
        known, shift = shift, max(0, shift - ROUND_BITS)
        wanted = keys if known == 64 else keys.where(F.shiftright("key", known).isin(sorted({bits for bits, _ in inside.values()})))
        counted = wanted.groupBy(F.shiftright("key", shift).alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = sorted((row["bits"], row["n"]) for row in counted)
        for rank, (bits, left) in inside.items():
            for next_bits, n in counts:
                if known < 64 and next_bits >> (known - shift) != bits:
                    continue
                if left < n:
                    inside[rank] = (next_bits, left)
                    break
                left -= n
    return {rank: bits for rank, (bits, _) in inside.items()}


def describe_real(df: DataFrame, column: str) -> DataFrame:
    """As :func:`describe_column` for any number; quartiles are exact, without a sort or a table of all values."""
    keys = stored(real_values(df, column).select("value", order_key("value").alias("key")), "order-keys")
    value = F.col("value")
    row = keys.agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    ).first()
    n, stats = row["count"], {k: None if row[k] is None else float(row[k]) for k in row.asDict()}
    if n:
        places = {label: (n - 1) * fraction for label, fraction in QUARTILES.items()}
        found = keys_at(keys.select("key"), sorted({f(p) for p in places.values() for f in (math.floor, math.ceil)}))
        for label, place in places.items():
            low, high = value_of_key(found[math.floor(place)]), value_of_key(found[math.ceil(place)])
            stats[label] = low if low == high else low + (high - low) * (place - math.floor(place))
    labels = list(schema.DESCRIBE_LABELS)
    return literal_table(df.sparkSession, subkey=labels, value=pa.array([stats.get(s) for s in labels], pa.float64()))


def histogram(counts: DataFrame, bins: int = schema.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over [min, max], closed on the left, the last on both sides.

    Bin numbers come from integer arithmetic. If all values are equal the range is widened by a
    half on both sides, which puts them into the middle bin.
    """
    bounds = counts.agg(F.struct(F.min("days").alias("low"), F.max("days").alias("high"))).scalar()
    low, high = F.col("bounds.low").cast("long"), F.col("bounds.high").cast("long")
    number = F.when(high == low, F.lit(bins // 2)).otherwise(
        F.least(
            F.floor(F.try_divide((F.col("days") - low) * F.lit(bins), high - low)).cast("int"), F.lit(bins - 1)
        )
    )
    filled = (
        counts.withColumn("bounds", bounds)
        .select(number.alias("bin"), "n")
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    left = F.when(high == low, low - F.lit(0.5)).otherwise(low.cast("double"))
    width = F.when(high == low, F.lit(1.0 / bins)).otherwise((high - low) / F.lit(bins))
    edges = (
        counts.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"), bounds.alias("bounds"))
        .select(
            "bin",
            (left + F.col("bin") * width).alias("bin_start"),
            (left + (F.col("bin") + 1) * width).alias("bin_end"),
        )
    )
    return edges.join(filled, "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce("n", F.lit(0)).alias("count")
    )


def real_histogram(df: DataFrame, column: str, bins: int = schema.HISTOGRAM_BINS) -> DataFrame:
    """As :func:`histogram` for any number: edges in doubles, and each value in the bin whose edges hold it.

    A bin's number comes from a division, which may be off by one at an edge; it is then corrected by comparing
    the value with the edges themselves. Infinite values have no bins (ValueError).
    """
    values = real_values(df, column)
    row = values.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    low, high = row["low"], row["high"]
    if low is None:
        edges = [None] * (bins + 1)
        number = F.lit(None).cast("int")
    else:
        if not math.isfinite(high - low):
            raise ValueError(f"{column} holds values too far apart for bins: {low} and {high}")
        if low == high:
            low, high = low - 0.5, high + 0.5
        edges = [*(i * ((high - low) / bins) + low for i in range(bins)), high]
        at = F.least(F.floor((F.col("value") - low) / (high - low) * bins).cast("int"), F.lit(bins - 1))
        bounds = F.lit(edges)
        at = F.when(F.col("value") < F.get(bounds, at), at - 1).otherwise(at)
        number = F.when((F.col("value") >= F.get(bounds, at + 1)) & (at < bins - 1), at + 1).otherwise(at)
    counted = values.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    table = literal_table(
        df.sparkSession, bin=pa.array(range(bins), pa.int32()), bin_start=pa.array(edges[:-1], pa.float64()), bin_end=pa.array(edges[1:], pa.float64())
    )
    return table.join(counted, "bin", "left").select("bin", "bin_start", "bin_end", F.coalesce("n", F.lit(0)).alias("count"))


def histogram_of_column(df: DataFrame, column: str, bins: int = schema.HISTOGRAM_BINS) -> DataFrame:
    if _is_real(df, column):
        return real_histogram(df, column, bins)
    return histogram(materialize(value_counts(df, column)), bins)

"""Cleaning of bookings: filling gaps, removing copies, deriving columns.

The order of the steps in :func:`clean_bookings` is part of the result: fill values are taken
before copies are removed, and copies are compared after filling.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger import schema
from roomledger.functions import columns as X
from roomledger.session import materialize, stored

# Columns that hold a row's digest; the most repeated digests sent to every executor; bits of the map beyond that.
_DIGEST = ("__digest_a", "__digest_b")
MOST_DIGESTS = 2_000_000
FEW_ROWS = 4_000_000
_ROWS = "__rows"
BITMAP_BITS = 1 << 29


def fill_values(
    df: DataFrame, mean_columns: Sequence[str] = (), mode_columns: Sequence[str] = (), rows: str | None = None
) -> DataFrame:
    """One row with the mean of some columns and the most frequent value of others.

    The table is read once: rows are grouped by each mode column, which leaves one small row per
    distinct value, and means come from the same groups. Ties go to the smallest value. ``rows`` names
    a column for the number of rows.
    """
    measures = [F.count(F.lit(1)).alias("_rows")]
    for c in mean_columns:
        measures += [F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_n_{c}")]
    if mode_columns:
        sets = [[F.col(c)] for c in mode_columns]
        groups = df.groupingSets(sets, *mode_columns).agg(F.grouping_id().alias("_set"), *measures)
    else:
        groups = df.agg(F.lit(0).alias("_set"), *measures)

    # grouping_id has one bit per column, first column highest; a grouped column's bit is 0.
    set_ids = [(1 << len(mode_columns)) - 1 - (1 << (len(mode_columns) - 1 - i)) for i in range(len(mode_columns))]
    once = F.col("_set") == (set_ids[0] if set_ids else 0)
    fills = [
        X.exact_mean(F.sum(F.when(once, F.col(f"_sum_{c}"))), F.sum(F.when(once, F.col(f"_n_{c}")))).alias(c)
        for c in mean_columns
    ]
    for c, set_id in zip(mode_columns, set_ids):
        counted = (F.col("_set") == set_id) & F.col(c).isNotNull()
        rank = F.when(counted, F.struct(-F.col("_rows"), F.col(c)))
        fills.append(F.min_by(c, rank).alias(c))
    if rows:
        fills.append(F.coalesce(F.sum(F.when(once, F.col("_rows"))), F.lit(0)).alias(rows))
    return groups.agg(*fills)


def impute(
    df: DataFrame,
    mean_columns: Sequence[str] = schema.MEAN_FILLED,
    mode_columns: Sequence[str] = schema.MODE_FILLED,
) -> DataFrame:
    """Fill NULLs with the column mean or the most frequent value; an all-NULL column stays NULL."""
    return _imputed(df, mean_columns, mode_columns)[0]


def _imputed(df: DataFrame, mean_columns: Sequence[str], mode_columns: Sequence[str]) -> tuple[DataFrame, int]:
    """The filled table and its number of rows; the one row of fill values is worked out here, once."""
    found = fill_values(df, mean_columns, mode_columns, _ROWS)
    values = found.first()
    kinds = {f.name: f.dataType for f in found.schema}
    filled = {c: F.coalesce(F.col(c), F.lit(values[c]).cast(kinds[c])) for c in (*mean_columns, *mode_columns)}
    return (df.withColumns(filled) if filled else df), values[_ROWS]


def impute_mean(df: DataFrame, columns: Sequence[str] = schema.MEAN_FILLED) -> DataFrame:
    return impute(df, columns, ())


def impute_mode(df: DataFrame, columns: Sequence[str] = schema.MODE_FILLED) -> DataFrame:
    return impute(df, (), columns)


def drop_copies(df: DataFrame, most_digests: int = MOST_DIGESTS, rows: int | None = None) -> DataFrame:
    """Keep one of the rows that are equal in all columns; only rows that may be copies are shuffled.

    The table is written once with a digest of 128 bits a row. Digests are counted first (narrow rows, combined in
    each task), and only rows whose digest occurs more than once move; these are compared in full, so a collision
    costs a move and never a row. Copies within a task collapse before they move, so a row copied very often costs
    each task one row. Rows with an unrepeated digest stay where they are and read only the columns asked for.

    Up to ``most_digests`` repeated digests are sent to every executor (16 bytes each). If there are more, a bitmap of
    fixed size goes out in their place; rows that hit it by chance move as well.

    ``rows``: how many rows there are, if known. Up to ``FEW_ROWS`` a shuffle of them costs less than writing them.
    """
    if rows is not None and rows <= FEW_ROWS:
        return df.dropDuplicates()
    if any(not _digestible(f.dataType) for f in df.schema) or len({c.lower() for c in df.columns}) < len(df.columns):
        return df.dropDuplicates()
    names = [F.col(f"`{c}`") for c in df.columns]
    gaps = [c.isNull() for c in names]
    marks = {mark: F.xxhash64(F.lit(seed), *names, *gaps) for seed, mark in enumerate(_DIGEST)}
    table = stored(df.withColumns(marks), "rows-with-digests")
    counted = table.groupBy(*_DIGEST).agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(counted.where("n > 1").select(*_DIGEST))
    n = repeated.count()
    if not n:
        return table.drop(*_DIGEST)
    alone, suspects = _split(table, repeated, n <= most_digests)
    return alone.drop(*_DIGEST).unionByName(suspects.drop(*_DIGEST).dropDuplicates())


def _split(table: DataFrame, repeated: DataFrame, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Rows whose digest surely occurs once, and the others."""
    if exact:
        sent = F.broadcast(repeated)
        return table.join(sent, list(_DIGEST), "left_anti"), table.join(sent, list(_DIGEST), "left_semi")
    # One row for 32,768 bits; a bit is set where a repeated digest's first half falls on it.
    place = F.pmod(F.col(_DIGEST[0]), F.lit(BITMAP_BITS))
    rows = repeated.select(F.floor(place / 32_768).cast("int").alias("__part"), (place % 32_768).alias("__bit"))
    bits = F.broadcast(rows.groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits")))
    keyed = table.withColumns({"__part": F.floor(place / 32_768).cast("int"), "__bit": (place % 32_768).cast("int")})
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, F.col("__bit") % 8) == 1, F.lit(False))
    tested = keyed.join(bits, "__part", "left").withColumn("__hit", hit).drop("__part", "__bit", "__bits")
    return tested.where(~F.col("__hit")).drop("__hit"), tested.where("__hit").drop("__hit")


def _digestible(kind: T.DataType) -> bool:
    """Whether equal values of a type surely have equal hashes, and Parquet can hold them."""
    if isinstance(kind, T.ArrayType):
        return _digestible(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_digestible(f.dataType) for f in kind)
    if isinstance(kind, T.StringType):
        return kind.isUTF8BinaryCollation()
    return isinstance(kind, (T.NumericType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType))


def parse_status_date(df: DataFrame, form: str = schema.DATE_FORMAT) -> DataFrame:
    """Status dates of a given format, or with ``form="infer"`` of the one format that fits all of them.

    A value that doesn't have the format stops the job; so does a column that fits no format or several ones.
    """
    text = F.col("reservation_status_date").cast("string")
    if form == schema.INFERRED_FORMAT:
        form = date_format_of(df, "reservation_status_date")
    return df.withColumn("reservation_status_date", X.strict_date(text, form))


def date_format_of(df: DataFrame, column: str, formats: Sequence[str] = schema.DATE_FORMATS) -> str:
    """The one of some formats that every value of a column has; ValueError if none or several give dates.

    Each value is the set of formats it has, as bits; one aggregate intersects them. Dates repeat, so equal values are
    combined in each task before any is parsed. Formats under which every value
    is the same date are no contradiction: the first of them counts. A column without values has the first format.
    """
    values = df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    text = F.col("value")
    dates = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    whole = [F.when(F.date_format(d, f) == text, d) for d, f in zip(dates, formats)]
    bits = reduce(operator.add, (F.when(d.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, d in enumerate(whole)))
    same = [
        F.bool_and(F.coalesce(whole[i] == whole[j], F.lit(False))).alias(f"{i}={j}") for i in range(len(formats)) for j in range(i + 1, len(formats))
    ]
    # Without the sum Spark would see that copies don't matter here, and parse every row.
    row = values.agg(F.sum("n").alias("rows"), F.bit_and(bits).alias("bits"), F.min(F.when(bits == 0, text)).alias("odd"), *same).first()
    if row["rows"] is None:
        return formats[0]
    fitting = [i for i in range(len(formats)) if row["bits"] >> i & 1]
    if not fitting:
        example = "" if row["odd"] is None else f", such as {row['odd']!r}"
        raise ValueError(f"no date format fits all values of {column}{example}")
    if not all(row[f"{fitting[0]}={j}"] for j in fitting[1:]):
        raise ValueError(f"the dates of {column} fit several formats, so name one: {[formats[i] for i in fitting]}")
    return formats[fitting[0]]


def derive_stays(df: DataFrame) -> DataFrame:
    return df.withColumn("total_stays", F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights"))


def derive_arrival_date(df: DataFrame) -> DataFrame:
    date = X.calendar_date(
        F.col("arrival_date_year"), F.col("arrival_date_month"), F.col("arrival_date_day_of_month")
    )
    return df.withColumn("arrival_date", date)


def derive_revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("total_revenue", F.col("adr") * F.col("total_stays"))


def lead_time_bins(
    df: DataFrame,
    edges: Sequence[float] = schema.LEAD_TIME_EDGES,
    labels: Sequence[str] = schema.LEAD_TIME_LABELS,
) -> DataFrame:
    return df.withColumn("lead_time_bin", X.bin_label(F.col("lead_time"), edges, labels))


def derive_columns(df: DataFrame, date_format: str = schema.DATE_FORMAT) -> DataFrame:
    """All row-wise steps; Spark folds them into one projection."""
    return (
        df.transform(parse_status_date, date_format)
        .transform(derive_stays)
        .transform(derive_arrival_date)
        .transform(derive_revenue)
        .transform(lead_time_bins)
    )


def clean_bookings(
    df: DataFrame,
    date_format: str = schema.DATE_FORMAT,
    mean_columns: Sequence[str] = schema.MEAN_FILLED,
    mode_columns: Sequence[str] = schema.MODE_FILLED,
) -> DataFrame:
    filled, rows = _imputed(df, mean_columns, mode_columns)
    return drop_copies(filled, rows=rows).transform(derive_columns, date_format)

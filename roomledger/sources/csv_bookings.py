"""Bookings from CSV files with a header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger import schema
from roomledger.sources import csv_splits


_CORRUPT = "_corrupt_record"


def read_raw(
    spark: SparkSession,
    path: str,
    columns: T.StructType | None = None,
    multi_line: bool = False,
    separator: str = ",",
    encoding: str = "UTF-8",
) -> DataFrame:
    """All fields as text, as they stand in the file, each under the name in the header.

    The header of one file names the columns, so their order doesn't matter; a file whose header differs
    from it stops the job, and so does a row with more or fewer fields than the header. ``columns`` must all
    be there (ValueError). Fields with line breaks need ``multi_line``; files in UTF-8 are read in splits all the
    same (see :mod:`~roomledger.sources.csv_splits`), others one task a file.
    """
    reader = spark.read.options(header=True, escape='"', multiLine=multi_line, sep=separator, encoding=encoding)
    names = reader.csv(path).columns
    if columns is not None and (missing := [f.name for f in columns if f.name not in names]):
        raise ValueError(f"the header lacks the columns {missing}")
    layout = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _CORRUPT)])
    if multi_line and encoding.upper().replace("-", "") == "UTF8":
        rows = _from_records(csv_splits.records(spark, path, separator), names, layout, separator)
    else:
        rows = reader.options(enforceSchema=False, columnNameOfCorruptRecord=_CORRUPT).schema(layout).csv(path)
    complaint = F.concat(F.lit("a row has another number of fields than the header: "), F.substring(_CORRUPT, 1, 200))
    refused = F.when(F.col(_CORRUPT).isNotNull(), F.raise_error(complaint).cast("string"))
    return rows.select(refused.otherwise(F.col(f"`{names[0]}`")).alias(names[0]), *(F.col(f"`{n}`") for n in names[1:]))


def _from_records(records: DataFrame, names: list[str], layout: T.StructType, separator: str) -> DataFrame:
    """The fields of records as text; a header that isn't the first file's stops the job."""
    options = {"sep": separator, "escape": '"', "columnNameOfCorruptRecord": _CORRUPT, "mode": "PERMISSIVE", "multiLine": "true"}
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in layout)
    row = F.from_csv("record", kinds, options)
    told = F.array(*(F.coalesce(row[n], F.lit("")) for n in names))
    differs = F.concat(F.lit("the header of a file differs from the others': "), F.substring("record", 1, 200))
    wrong = F.col("header") & ((told != F.lit(names)) | row[_CORRUPT].isNotNull())
    checked = F.when(wrong, F.raise_error(differs).cast("boolean")).otherwise(F.col("header"))
    return records.where(~checked).select(row.alias("row")).select("row.*")


def _present(column: str) -> Column:
    """The field's text, or NULL for any of the spellings of a missing value."""
    return F.when(~F.col(column).isin(*schema.NA_TOKENS), F.col(column))


def _typed(column: str, target: T.DataType) -> Column:
    text = _present(column)
    if isinstance(target, T.StringType):
        return text
    if isinstance(target, T.IntegerType):
        number = text.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast("int"))
        return F.coalesce(text.try_cast("int"), whole)
    value = text.try_cast(target)
    return F.nanvl(value, F.lit(None).cast(target)) if isinstance(target, T.DoubleType) else value


_WHOLE = r"^ *[+-]?\d+ *$"
_REAL = r"^ *[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)? *$|^ *[+-]?([iI][nN][fF]|[iI]nfinity) *$"
#: What a value can be read as, as bits that an aggregate unites: a whole number, a real one, a truth value, text, nothing.
_KINDS = {"whole": 1, "real": 2, "truth": 4, "text": 8, "missing": 16}


def _kind(column: str) -> Column:
    text = _present(f"`{column}`")
    return (
        F.when(text.isNull(), _KINDS["missing"])
        .when(text.isin("True", "TRUE", "true", "False", "FALSE", "false"), _KINDS["truth"])
        .when(text.rlike(_WHOLE), F.when(text.try_cast("bigint").isNotNull(), _KINDS["whole"]).otherwise(_KINDS["text"]))
        .when(text.rlike(_REAL), _KINDS["real"])
        .otherwise(_KINDS["text"])
    )


def inferred_types(raw: DataFrame, columns: T.StructType = schema.BOOKINGS) -> T.StructType:
    """``columns``, and the types of all other columns from one aggregate over all their values.

    Whole numbers only: long; whole and real ones, or nothing at all: double; truth values without a gap: boolean;
    anything else: string, also whole numbers that don't fit 64 bits.
    """
    others = [c for c in raw.columns if c not in columns.names]
    if not others:
        return columns
    found = raw.agg(*(F.bit_or(_kind(c)).alias(c) for c in others)).first()
    real, whole, truth, missing = (_KINDS[k] for k in ("real", "whole", "truth", "missing"))
    types = []
    for c in others:
        bits = missing if found[c] is None else found[c]
        if bits & ~missing == whole:
            kind = T.LongType()
        elif not bits & ~(missing | whole | real):
            kind = T.DoubleType()
        else:
            kind = T.BooleanType() if bits == truth else T.StringType()
        types.append(T.StructField(c, kind))
    return T.StructType([*columns.fields, *types])


def typed_bookings(raw: DataFrame, columns: T.StructType = schema.BOOKINGS) -> DataFrame:
    """Text to the column types; other columns of the file stay text. No NaN gets in."""
    types = {f.name: f.dataType for f in columns}
    return raw.select(*[_typed(f"`{c}`", types.get(c, T.StringType())).alias(c) for c in raw.columns])


def rejected_values(raw: DataFrame, columns: T.StructType = schema.BOOKINGS) -> DataFrame:
    """Per typed column the number of fields that hold text, but none of the column's type."""
    checked = [f for f in columns if f.name in raw.columns and not isinstance(f.dataType, T.StringType)]
    bad = [
        F.count_if(_present(f.name).isNotNull() & _typed(f.name, f.dataType).isNull()).alias(f.name) for f in checked
    ]
    return raw.agg(*bad).unpivot([], [f.name for f in checked], "column", "rejected")


def read_bookings(
    spark: SparkSession,
    path: str,
    columns: T.StructType | None = None,
    multi_line: bool = False,
    separator: str = ",",
    encoding: str = "UTF-8",
    infer: bool = True,
) -> DataFrame:
    """Typed bookings. ``columns`` also sets the types of columns beyond the standard ones.

    The types of columns without one come from their values (a pass over those columns alone); with
    ``infer=False`` they stay text.
    """
    raw = read_raw(spark, path, columns, multi_line, separator, encoding)
    types = columns or schema.BOOKINGS
    return typed_bookings(raw, inferred_types(raw, types) if infer else types)

"""From booking files to insights, charts and documents, and from questions to answers.

Every output is replaced as a whole, so a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger import schema
from roomledger.functions.vectors import Embedder
from roomledger.operators import answers as A
from roomledger.operators import charts as H
from roomledger.operators import cleaning as C
from roomledger.operators import documents as D
from roomledger.operators import insights as I
from roomledger.operators import retrieval as R
from roomledger.session import materialize
from roomledger.sources import chart_files, csv_bookings, stores


def build(
    spark: SparkSession,
    bookings: str | DataFrame,
    output: str,
    charts: str | None = None,
    embedder: Embedder | None = None,
    columns: T.StructType | None = None,
    names: Mapping[str, str] | None = None,
    multi_line: bool = False,
    separator: str = ",",
    encoding: str = "UTF-8",
    date_format: str = schema.DATE_FORMAT,
    mean_columns: Sequence[str] = schema.MEAN_FILLED,
    mode_columns: Sequence[str] = schema.MODE_FILLED,
) -> dict[str, str]:
    """Insights, chart series and the document store of some bookings; returns their paths.

    ``bookings`` is a CSV path or a frame, ``charts`` a folder of PNG files. The bookings are read
    twice: once for the fill values, once to be filled and written with their digests, from where copies are found. ``names`` maps the library's column
    names to those of the bookings, where they differ. From CSV, ``rejected`` counts for each column the
    fields that hold text but none of its type (they are read as missing); columns without a type get the one that
    fits all their values. ``date_format`` is that of the status dates (``"infer"``: the one that fits all of them),
    ``mean_columns`` and ``mode_columns`` are the columns whose gaps are filled.
    """
    paths = {name: f"{output.rstrip('/')}/{name}" for name in ("insights", "charts", "documents")}
    if isinstance(bookings, str):
        raw = renamed(csv_bookings.read_raw(spark, bookings, None, multi_line, separator, encoding), names)
        paths["rejected"] = f"{output.rstrip('/')}/rejected"
        csv_bookings.rejected_values(raw, columns or schema.BOOKINGS).write.mode("overwrite").parquet(paths["rejected"])
        frame = csv_bookings.typed_bookings(raw, csv_bookings.inferred_types(raw, columns or schema.BOOKINGS))
    else:
        frame = renamed(bookings, names)
    missing = [f.name for f in schema.BOOKINGS if f.name not in frame.columns]
    if missing:
        raise ValueError(f"the bookings lack the columns {missing}")
    rollup = materialize(I.booking_rollup(C.clean_bookings(frame, date_format, mean_columns, mode_columns)))
    insights = materialize(I.insights_from_rollup(rollup))
    stores.save_insights(insights, paths["insights"])
    H.chart_series(rollup, insights).write.mode("overwrite").parquet(paths["charts"])
    files = chart_files.read_charts(spark, charts) if charts else None
    stores.save_documents(D.embed(D.all_documents(insights, files), "page_content", embedder), paths["documents"])
    return paths


def prompts(
    questions: DataFrame,
    store: DataFrame,
    embedder: Embedder | None = None,
    k: int = schema.NEIGHBOURS,
    template: str = schema.PROMPT_TEMPLATE,
) -> DataFrame:
    """What a model needs per question (``question_id, question``), and what its answer will need.

    Write the result, let a model add ``raw_answer``, and pass it to :func:`answers`.
    """
    found = R.nearest_documents(D.embed(questions, "question", embedder), store, k)
    described = R.per_question(questions, found, store)
    return described.withColumn("prompt", A.prompt(F.col("context"), F.col("question"), template))


def answers(described: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Answers, with response times if there is a request log (``question_id, started_at, ended_at``)."""
    assembled = A.assemble(described)
    return assembled if log is None else A.timed(assembled, log)


def renamed(bookings: DataFrame, names: Mapping[str, str] | None) -> DataFrame:
    """Bookings under the library's column names; ``names``: library name to the bookings' name."""
    if not names:
        return bookings
    unknown = [n for n in names.values() if n not in bookings.columns]
    if unknown:
        raise ValueError(f"the bookings lack the columns {unknown}")
    return bookings.withColumnsRenamed({theirs: own for own, theirs in names.items()})

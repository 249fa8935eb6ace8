"""Every operator as a query over the test tables.

Results hold text, numbers and booleans only: dates are written as text, money as doubles, and
maps and vectors as text or columns, so that any engine's rows can be compared with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger import schema
from roomledger.operators import answers as A
from roomledger.operators import charts as H
from roomledger.operators import cleaning as C
from roomledger.operators import describe as D
from roomledger.operators import documents as T
from roomledger.operators import evaluation as E
from roomledger.operators import insights as I
from roomledger.operators import retrieval as R
from roomledger.plans import sample_questions as Q
from roomledger.plans import sample_tables as S
from roomledger.session import materialize, scratch_path
from roomledger.sources import csv_bookings, stores

Query = Callable[[SparkSession, str], DataFrame]


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text."""
    casts: dict[str, Column] = {}
    for name, kind in df.dtypes:
        if kind.startswith("decimal"):
            casts[name] = F.col(name).cast("double")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            casts[name] = F.col(name).cast("string")
    return df.withColumns(casts) if casts else df


def _on_bookings(step: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    """A step over raw bookings; ``columns`` are what is shown of the result."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = step(S.bookings(spark, folder))
        return _plain(out.select(*columns) if columns else out)

    return run


def clean_bookings(spark: SparkSession, folder: str) -> DataFrame:
    return C.clean_bookings(S.bookings(spark, folder))


def _on_clean(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: _plain(step(clean_bookings(spark, folder)))


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def scan_bookings(spark: SparkSession, folder: str) -> DataFrame:
    """Bookings written as CSV, with missing values spelled in several ways, and read back."""
    rows = S.bookings(spark, folder).drop("l_orderkey", "l_linenumber")
    spellings = {"children": "NA", "agent": "NULL", "company": "n/a", "country": ""}
    path = scratch_path(spark, "bookings-csv")
    rows.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(text)) for c, text in spellings.items()}
    ).write.option("header", True).csv(path)
    return csv_bookings.read_bookings(spark, path)


def scan_typed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Bookings with columns that have no type, in mixed spellings; copies show only once types are found."""
    points, visits = F.col("stays_in_week_nights").cast("string"), F.col("stays_in_weekend_nights").cast("string")
    spelling = F.monotonically_increasing_id() % 3
    rows = S.bookings(spark, folder).withColumns(
        {
            "points": F.when(spelling == 0, points).when(spelling == 1, F.concat(points, F.lit(".0"))).otherwise(F.concat(F.lit("0"), points)),
            "visits": F.when(spelling == 0, F.concat(F.lit("+"), visits)).otherwise(visits),
            "member": F.when(F.col("is_canceled") == 1, "True").otherwise("false"),
            "code": F.when(F.col("l_linenumber") == 1, "A1").otherwise(points),
        }
    )
    path = scratch_path(spark, "typed-csv")
    rows.write.option("header", True).csv(path)
    return C.drop_copies(csv_bookings.read_bookings(spark, path))


def scan_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages, full of quotes and line breaks, written as CSV and read back in splits."""
    path = scratch_path(spark, "pages-csv")
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    S.wide_table(spark, folder, "pages").write.options(**options).csv(path)
    return csv_bookings.read_raw(spark, path, multi_line=True)


def status_date_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Status dates in a format that is found from them, and in one that is given."""
    rows = S.bookings(spark, folder).select("l_orderkey", "l_linenumber", F.col("reservation_status_date").cast("date").alias("date"))
    slashes = rows.withColumn("reservation_status_date", F.date_format("date", "M/d/yyyy"))
    found = C.parse_status_date(slashes, schema.INFERRED_FORMAT).withColumnRenamed("reservation_status_date", "found")
    dots = found.withColumn("reservation_status_date", F.date_format("date", "dd.MM.yyyy"))
    return C.parse_status_date(dots, "dd.MM.yyyy").withColumnRenamed("reservation_status_date", "given").drop("date")


def price_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(D.describe_column(S.wide_table(spark, folder, "lineitem"), "l_extendedprice"), "value", places=4)


def price_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(D.histogram_of_column(S.wide_table(spark, folder, "lineitem"), "l_extendedprice"), "bin_start", "bin_end")


def insights(spark: SparkSession, folder: str) -> DataFrame:
    return I.insights_long(clean_bookings(spark, folder))


def insights_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = insights(spark, folder).withColumn("category_no", I.category_number(F.col("category")))
    return _rounded(rows, "value")


def insights_json(spark: SparkSession, folder: str) -> DataFrame:
    """Insights written as JSON and read back."""
    path = stores.save_insights(materialize(insights(spark, folder)), scratch_path(spark, "insights-json"))
    return _rounded(stores.load_insights(spark, path), "value")


def chart_series(spark: SparkSession, folder: str) -> DataFrame:
    rollup = materialize(I.booking_rollup(clean_bookings(spark, folder)))
    return _rounded(H.chart_series(rollup), "value")


def _flat(documents: DataFrame) -> DataFrame:
    keys = {"category": "category", "subkey": "subkey", "type": "type", "graph_name": "graph_name",
            "description": "description", "image_base64": "image"}
    return stores.flat_documents(documents).select("doc_id", "page_content", *[F.col(k).alias(name) for k, name in keys.items()])


def insight_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = T.insight_documents(insights(spark, folder)).unionByName(T.description_documents(spark))
    return documents.select(
        "doc_id", "page_content",
        F.col("metadata").getItem("category").alias("category"),
        F.col("metadata").getItem("subkey").alias("subkey"),
    )


def graph_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(T.graph_documents(S.chart_files(spark, folder))).drop("category", "subkey")


def all_documents(spark: SparkSession, folder: str) -> DataFrame:
    return T.all_documents(insights(spark, folder), S.chart_files(spark, folder))


def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of whole texts, each as its entries in millionths."""
    vectors = T.embed(S.wide_table(spark, folder, "documents").select("doc_id", "text"), "text")
    entries = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string"))
    return vectors.select("doc_id", F.array_join(entries, ",").alias("vector"))


def document_store(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their vectors, written and opened again."""
    vectors = T.embed(all_documents(spark, folder), "page_content")
    return stores.load_documents(spark, stores.save_documents(vectors, scratch_path(spark, "documents")))


def vector_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return R.nearest_documents(S.vector_questions(spark, folder), S.vector_documents(spark, folder))


def vector_neighbours_by_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The same neighbours by the way for documents too large to broadcast."""
    return R.nearest_by_cells(
        S.vector_questions(spark, folder), S.vector_documents(spark, folder), pivots=16, block_documents=100, block_questions=100
    )


def vector_neighbours_by_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same neighbours with questions streaming past pages of documents."""
    return R.nearest_by_stream(S.vector_questions(spark, folder), S.vector_documents(spark, folder), page_bytes=1 << 18)


def _short_vectors(vectors: DataFrame) -> DataFrame:
    """A ten-thousandth of their length, so that all distances vanish when rounded to six decimals."""
    return vectors.withColumn("embedding", F.transform("embedding", lambda x: (x * F.lit(0.0001)).cast("float")))


def short_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return R.nearest_documents(_short_vectors(S.vector_questions(spark, folder)), _short_vectors(S.vector_documents(spark, folder)))


def short_neighbours_by_stream(spark: SparkSession, folder: str) -> DataFrame:
    return R.nearest_by_stream(_short_vectors(S.vector_questions(spark, folder)), _short_vectors(S.vector_documents(spark, folder)))


def short_neighbours_by_cells(spark: SparkSession, folder: str) -> DataFrame:
    return R.nearest_by_cells(_short_vectors(S.vector_questions(spark, folder)), _short_vectors(S.vector_documents(spark, folder)))


def _described_vectors(spark: SparkSession, folder: str) -> DataFrame:
    ids = S.vector_questions(spark, folder).select("question_id")
    found = vector_neighbours(spark, folder)
    return R.per_question(ids, found, S.vector_documents(spark, folder))


def rag_prompt(spark: SparkSession, folder: str) -> DataFrame:
    question = F.concat(F.lit("What is near vector "), F.col("question_id"), F.lit("?"))
    return _described_vectors(spark, folder).select("question_id", A.prompt(F.col("context"), question).alias("prompt"))


def has_relevant_info(spark: SparkSession, folder: str) -> DataFrame:
    return _described_vectors(spark, folder).select("question_id", "has_relevant_info")


def first_graph(spark: SparkSession, folder: str) -> DataFrame:
    return _described_vectors(spark, folder).select("question_id", "graph", "graph_description")


def answer_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Every assistant turn as raw answer: odd turns padded, every fourth turn blank; no-break and wide spaces among them."""
    raw = F.expr("case when turn % 4 = 3 then ' \n\t\u00a0 ' else concat('\u00a0\n  ', text, ' \u2003\t') end")
    relevant = F.col("conv_id") % 5 != 0
    return S.wide_table(spark, folder, "conversations").select(
        "conv_id", "turn", A.with_fallback(raw, relevant).alias("answer")
    )


def format_answer(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.expr(
        "concat(text, ' $ ', turn, '.5 and ', turn, '\u00a0% for $1,234.50 at City Hotel, Resort Hotels, "
        "Directly or Offline TA/TO')"
    )
    return S.wide_table(spark, folder, "conversations").select("conv_id", "turn", A.format_answer(raw).alias("answer"))


def answer_graph_note(spark: SparkSession, folder: str) -> DataFrame:
    answer = F.expr(
        "case when turn % 3 = 0 then concat(text, ' I currently don''t have this data available') "
        "when turn % 3 = 1 then concat(text, '!') else text end"
    )
    graph = F.expr("case when conv_id % 3 = 0 then role when conv_id % 3 = 1 then '' end")
    return S.wide_table(spark, folder, "conversations").select(
        "conv_id", "turn", A.with_graph_note(answer, graph).alias("answer")
    )


def retrieved(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, the stored documents, and the nearest documents of every question."""
    store = document_store(spark, folder)
    asked = S.questions(spark, folder)
    found = R.nearest_documents(T.embed(asked, "question"), store)
    return asked, store, found


def retrieve_documents(spark: SparkSession, folder: str) -> DataFrame:
    return retrieved(spark, folder)[2]


def answer_questions(spark: SparkSession, folder: str) -> DataFrame:
    asked, store, found = retrieved(spark, folder)
    return A.assemble(R.per_question(asked, found, store))


def timed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with their response times, from a log that has no entry for some questions."""
    return A.timed(answer_questions(spark, folder), S.answer_log(spark, folder))


def answers_average_time(spark: SparkSession, folder: str) -> DataFrame:
    times = timed_answers(spark, folder).where("response_time is not null")
    return _rounded(E.average_response_time(times), "average_response_time")


def answers_report(spark: SparkSession, folder: str) -> DataFrame:
    asked = S.questions(spark, folder).select(F.col("question_id").alias("question_number"), "question")
    answered = timed_answers(spark, folder).withColumnRenamed("question_id", "question_number")
    return E.evaluation_report(answered.join(asked, "question_number"))


def answer_time_suffix(spark: SparkSession, folder: str) -> DataFrame:
    times = E.response_times(S.request_log(spark, folder))
    return times.select(
        "question_number", A.with_response_time(F.col("answer"), F.col("response_time")).alias("answer")
    )


def response_time(spark: SparkSession, folder: str) -> DataFrame:
    return E.response_times(S.request_log(spark, folder)).select("question_number", "response_time")


def evaluate_latency(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(E.average_response_time(E.response_times(S.request_log(spark, folder))), "average_response_time")


def evaluation_report(spark: SparkSession, folder: str) -> DataFrame:
    return E.evaluation_report(E.response_times(S.request_log(spark, folder)))


QUERIES: dict[str, Query] = {
    "scan_bookings": lambda spark, folder: _plain(scan_bookings(spark, folder)),
    "scan_typed_columns": lambda spark, folder: _plain(scan_typed_columns(spark, folder)),
    "scan_line_breaks": scan_line_breaks,
    "status_date_formats": lambda spark, folder: _plain(status_date_formats(spark, folder)),
    "price_stats": price_stats,
    "price_histogram": price_histogram,
    "revenue_stats": _on_clean(lambda df: _rounded(D.describe_column(df, "total_revenue"), "value", places=4)),
    "impute_mean": _on_bookings(C.impute_mean),
    "impute_mode": _on_bookings(C.impute_mode),
    "dedup_rows": _on_bookings(C.drop_copies),
    "parse_status_date": _on_bookings(C.parse_status_date, "l_orderkey", "l_linenumber", "reservation_status_date"),
    "derive_stays": _on_bookings(C.derive_stays, "l_orderkey", "l_linenumber", "total_stays"),
    "derive_arrival_date": _on_bookings(C.derive_arrival_date, "l_orderkey", "l_linenumber", "arrival_date"),
    "derive_revenue": _on_bookings(
        lambda df: C.derive_revenue(C.derive_stays(df)), "l_orderkey", "l_linenumber", "total_revenue"
    ),
    "lead_time_bins": _on_bookings(C.lead_time_bins, "l_orderkey", "l_linenumber", "lead_time", "lead_time_bin"),
    "clean_bookings": _on_clean(lambda df: df),
    "monthly_revenue": _on_clean(I.monthly_revenue),
    "revenue_by_hotel": _on_clean(I.revenue_by_hotel),
    "revenue_by_room": _on_clean(I.revenue_by_room),
    "revenue_by_segment": _on_clean(I.revenue_by_segment),
    "overall_cancellation_rate": _on_clean(I.overall_cancellation_rate),
    "cancellation_by_hotel": _on_clean(I.cancellation_by_hotel),
    "cancellation_by_channel": _on_clean(I.cancellation_by_channel),
    "cancellation_by_lead_time": _on_clean(I.cancellation_by_lead_time),
    "top_countries": _on_clean(I.top_countries),
    "lead_time_stats": _on_clean(lambda df: _rounded(I.lead_time_stats(df), "value")),
    "length_of_stay_stats": _on_clean(lambda df: _rounded(I.length_of_stay_stats(df), "value")),
    "booking_channel_percentage": _on_clean(I.booking_channel_percentage),
    "adr_by_customer_type": _on_clean(I.adr_by_customer_type),
    "insights_long": insights_long,
    "insights_json": insights_json,
    "lead_time_histogram": _on_clean(lambda df: _rounded(I.lead_time_histogram(df), "bin_start", "bin_end")),
    "chart_series": chart_series,
    "insight_documents": insight_documents,
    "graph_documents": graph_documents,
    "documents_all": lambda spark, folder: _flat(all_documents(spark, folder)),
    "embed_documents": embed_documents,
    "knn_top5": vector_neighbours,
    "knn_top5_by_cells": vector_neighbours_by_cells,
    "knn_top5_by_stream": vector_neighbours_by_stream,
    "knn_short_vectors": short_neighbours,
    "knn_short_vectors_by_stream": short_neighbours_by_stream,
    "knn_short_vectors_by_cells": short_neighbours_by_cells,
    "retrieve_documents": retrieve_documents,
    "rag_prompt": rag_prompt,
    "has_relevant_info": has_relevant_info,
    "first_graph": first_graph,
    "answer_fallback": answer_fallback,
    "format_answer": format_answer,
    "answer_graph_note": answer_graph_note,
    "answer_questions": answer_questions,
    "timed_answers": timed_answers,
    "answers_average_time": answers_average_time,
    "answers_report": answers_report,
    "answer_time_suffix": answer_time_suffix,
    "response_time": response_time,
    "evaluate_latency": evaluate_latency,
    "evaluation_report": evaluation_report,
    "ask_revenue_of_month": _on_clean(lambda df: Q.revenue_of_month(df, 1997, 7)),
    "ask_cancellations_by_country": _on_clean(Q.cancellations_by_country),
    "ask_average_price": _on_clean(Q.average_booking_price),
    "ask_city_hotel_cancellation": _on_clean(lambda df: Q.cancellation_rate_of_hotel(df, "City Hotel")),
    "ask_top_segment_by_bookings": _on_clean(Q.top_segment_by_bookings),
    "ask_top_segment_by_cancellation": _on_clean(Q.top_segment_by_cancellation),
    "ask_monthly_trend": _on_clean(Q.monthly_revenue_trend),
    "ask_lead_time_and_cancellation": _on_clean(Q.lead_time_and_cancellation),
    "ask_top_customer_type_by_revenue": _on_clean(Q.top_customer_type_by_revenue),
    "ask_resort_hotel_stay": _on_clean(lambda df: Q.average_stay_of_hotel(df, "Resort Hotel")),
}

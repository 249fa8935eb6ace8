"""From a model's raw text to the answer shown: fallback, formatting, notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger import schema
from roomledger.functions import columns as X
from roomledger.operators.evaluation import response_times


def prompt(context: Column, question: Column, template: str = schema.PROMPT_TEMPLATE) -> Column:
    """The model's input; a question without documents has an empty context."""
    return X.fill_template(template, context=F.coalesce(context, F.lit("")), question=question)


def with_fallback(raw: Column, has_relevant_info: Column) -> Column:
    """The stripped raw answer, or a fixed text if it is empty or nothing relevant was found."""
    text = X.strip(raw)
    missing = text.isNull() | (text == "") | ~F.coalesce(has_relevant_info, F.lit(False))
    return F.when(missing, F.lit(schema.NO_DATA_ANSWER)).otherwise(text)


def format_answer(
    text: Column,
    segments: Sequence[str] = schema.BOLD_SEGMENTS,
    hotels: Sequence[str] = schema.BOLD_HOTELS,
) -> Column:
    return X.bold_names(X.bold_names(X.bold_amounts(text), segments), hotels)


def with_graph_note(answer: Column, graph: Column) -> Column:
    """Point to the chart, if there is one and the answer has data."""
    noted = F.coalesce(graph, F.lit("")) != ""
    has_data = ~answer.contains(schema.NO_DATA_SENTENCE)
    period = F.when(answer.endswith("."), F.lit("")).otherwise(F.lit("."))
    return F.when(noted & has_data, F.concat(answer, period, F.lit(schema.GRAPH_NOTE))).otherwise(answer)


def with_response_time(answer: Column, seconds: Column) -> Column:
    """Append the response time, unless the answer ends with it already."""
    note = F.concat(F.lit("(Response time: "), X.two_decimals(seconds), F.lit(" seconds)"))
    return F.when(answer.endswith(note), answer).otherwise(F.concat(answer, F.lit("\n\n"), note))


def final_answer(raw: Column, has_relevant_info: Column, graph: Column) -> Column:
    return with_graph_note(format_answer(with_fallback(raw, has_relevant_info)), graph)


def assemble(described: DataFrame) -> DataFrame:
    """Answers from ``question_id, raw_answer, has_relevant_info, graph, graph_description``.

    The chart is returned with the fallback answer too.
    """
    answer = final_answer(F.col("raw_answer"), F.col("has_relevant_info"), F.col("graph"))
    return described.select("question_id", answer.alias("answer"), "graph", "graph_description")


def timed(answered: DataFrame, log: DataFrame) -> DataFrame:
    """Answers as they are returned: with the response time, in the text and as a column.

    ``log`` has ``question_id, started_at, ended_at``, one row a question; an answer without one stays as it is.
    """
    times = response_times(log).select("question_id", "response_time")
    shown = F.when(F.col("response_time").isNull(), F.col("answer")).otherwise(
        with_response_time(F.col("answer"), F.col("response_time"))
    )
    return answered.join(times, "question_id", "left").withColumn("answer", shown)

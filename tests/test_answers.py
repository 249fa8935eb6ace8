from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from roomledger import schema
from roomledger.operators import answers as A
from roomledger.operators import evaluation as E


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast(t).alias(n) for n, (v, t) in values.items()])
    return df.select(column).first()[0]


FORMATS = {
    "12.5 % and $ 1,234.50": "**12.5%** and **$1**,234.50",
    "$5%": "$**5%**",
    "Directly": "**Direct**ly",
    "37% of City Hotel bookings": "**37%** of **City Hotel** bookings",
    "Resort Hotels cost $ 99.95.": "**Resort Hotel**s cost **$99.95**.",
    "Offline TA/TO, Online TA and Online TA": "**Offline TA/TO**, **Online TA** and **Online TA**",
    "city hotel": "city hotel",
    "5 \n%": "**5%**",
    "": "",
}


def test_formatting(spark):
    df = spark.createDataFrame([(t,) for t in FORMATS], "t string")
    assert [r[0] for r in df.select(A.format_answer(F.col("t"))).collect()] == list(FORMATS.values())


def test_formatting_twice_adds_more(spark):
    df = spark.createDataFrame([("Direct",)], "t string")
    assert df.select(A.format_answer(A.format_answer(F.col("t")))).first()[0] == "****Direct****"


@pytest.mark.parametrize(
    "raw, relevant, expected",
    [
        ("  yes \n", True, "yes"),
        (" \t\n ", True, schema.NO_DATA_ANSWER),
        ("", True, schema.NO_DATA_ANSWER),
        (None, True, schema.NO_DATA_ANSWER),
        ("yes", False, schema.NO_DATA_ANSWER),
        ("yes", None, schema.NO_DATA_ANSWER),
    ],
)
def test_fallback(spark, raw, relevant, expected):
    column = A.with_fallback(F.col("raw"), F.col("relevant"))
    assert one(spark, column, raw=(raw, "string"), relevant=(relevant, "boolean")) == expected


@pytest.mark.parametrize(
    "answer, graph, expected",
    [
        ("It is 5", "img", "It is 5. A graph is available to illustrate this data."),
        ("It is 5.", "img", "It is 5. A graph is available to illustrate this data."),
        ("It is 5", None, "It is 5"),
        ("It is 5", "", "It is 5"),
        (schema.NO_DATA_ANSWER, "img", schema.NO_DATA_ANSWER),
        ("Sorry. I currently don't have this data available", "img", "Sorry. I currently don't have this data available"),
    ],
)
def test_graph_note(spark, answer, graph, expected):
    column = A.with_graph_note(F.col("answer"), F.col("graph"))
    assert one(spark, column, answer=(answer, "string"), graph=(graph, "string")) == expected


def test_response_time_note(spark):
    column = A.with_response_time(F.col("a"), F.col("t"))
    once = one(spark, column, a=("Yes.", "string"), t=(1.256, "double"))
    assert once == "Yes.\n\n(Response time: 1.26 seconds)"
    assert one(spark, column, a=(once, "string"), t=(1.256, "double")) == once
    assert one(spark, column, a=(once, "string"), t=(2.0, "double")).endswith("(Response time: 2.00 seconds)")


def test_prompt(spark):
    column = A.prompt(F.col("c"), F.col("q"))
    text = one(spark, column, c=("see {question} $1 \\", "string"), q=("why {context}?", "string"))
    assert text.endswith("Context: see {question} $1 \\\nQuestion: why {context}?\nAnswer:\n")
    assert text.startswith("\nYou are a hotel booking data analyst.")
    assert one(spark, column, c=(None, "string"), q=("why?", "string")).endswith("Context: \nQuestion: why?\nAnswer:\n")
    own = A.prompt(F.col("c"), F.col("q"), "{question}|{context}|{question}")
    assert one(spark, own, c=("C", "string"), q=("Q", "string")) == "Q|C|Q"


def test_assembled_answers(spark):
    described = spark.createDataFrame(
        [("a", "About 5 % at City Hotel", True, "img", "d"), ("b", "x", False, "img", "d"), ("c", None, True, None, None)],
        "question_id string, raw_answer string, has_relevant_info boolean, graph string, graph_description string",
    )
    out = A.assemble(described)
    assert out.schema == T_.StructType(schema.ANSWERS.fields[:-1])
    rows = {r.question_id: tuple(r)[1:] for r in out.collect()}
    assert rows["a"] == ("About **5%** at **City Hotel**. A graph is available to illustrate this data.", "img", "d")
    assert rows["b"] == (schema.NO_DATA_ANSWER, "img", "d")
    assert rows["c"] == (schema.NO_DATA_ANSWER, None, None)


def test_evaluation(spark):
    log = spark.sql(
        """select * from values
           (1, 'q1', 'a1', 'img', timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:00:01.255'),
           (2, 'q2', 'a2', '', timestamp_ntz'2024-01-01 23:59:59.5', timestamp_ntz'2024-01-02 00:00:00'),
           (3, 'q3', 'a3', null, timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:00:00')
           t(question_number, question, answer, graph, started_at, ended_at)"""
    )
    times = E.response_times(log)
    assert [r.response_time for r in times.orderBy("question_number").collect()] == [1.255, 0.5, 0.0]
    assert E.average_response_time(times).first()[0] == pytest.approx(1.755 / 3)
    assert tuple(E.average_response_time(times.where("false")).first()) == (0.0, 0)
    report = E.evaluation_report(times).orderBy("question_number").collect()
    assert [(r.question_number, r.has_graph, r.response_seconds) for r in report] == [
        (1, "Yes", f"{1.255:.2f}"), (2, "No", "0.50"), (3, "No", "0.00"),
    ]


def test_white_space_of_any_kind(spark):
    rows = spark.createDataFrame([("\u00a0\u2003\n a b\u3000",), ("\u00a0 \u202f",), ("12\u00a0% and $\u00a05",)], "t string")
    out = [r[0] for r in rows.select(A.format_answer(A.with_fallback(F.col("t"), F.lit(True)))).collect()]
    assert out == ["a b", schema.NO_DATA_ANSWER, "**12%** and **$5**"]

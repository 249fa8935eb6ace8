from __future__ import annotations

import json
from pathlib import Path

import pytest
from conftest import EDGE_CSV
from pyspark.sql import functions as F

from roomledger import schema
from roomledger.operators import charts as H
from roomledger.operators import insights as I
from roomledger.plans import sample_questions as Q
from roomledger.plans import workflow
from roomledger.sources import stores


def test_from_files_to_answers(spark, edge_csv, tmp_path):
    charts = tmp_path / "plots"
    charts.mkdir()
    for name in schema.CHART_DESCRIPTIONS:
        (charts / f"{name}.png").write_bytes(name.encode())
    for _ in range(2):
        paths = workflow.build(spark, edge_csv, str(tmp_path / "out"), str(charts))
    store = stores.load_documents(spark, paths["documents"])
    assert store.count() == 49 + 3 + 5
    lines = [json.loads(x) for f in Path(paths["insights"]).glob("part-*") for x in f.read_text().splitlines()]
    assert {line["category"] for line in lines} == set(schema.CATEGORIES)
    assert spark.read.parquet(paths["charts"]).select("chart").distinct().count() == 5

    questions = spark.createDataFrame(
        [("1", "cancellation by hotel city hotel", " About 50 % at City Hotel "),
         ("2", "graph top countries by number of bookings", "GBR leads"), ("3", "revenue by segment", None)],
        "question_id string, question string, raw_answer string",
    )
    described = workflow.prompts(questions, store).cache()
    rows = {r.question_id: r for r in described.collect()}
    assert "cancellation_by_hotel - City Hotel: 0.50" in rows["1"].context
    assert rows["1"].context in rows["1"].prompt and "Question: revenue by segment\n" in rows["3"].prompt
    out = {r.question_id: r for r in workflow.answers(described).collect()}
    assert out["1"].answer.startswith("About **50%** at **City Hotel**")
    assert out["2"].graph_description == schema.CHART_DESCRIPTIONS["top_countries"]
    assert out["2"].answer == "GBR leads. A graph is available to illustrate this data."
    assert out["3"].answer == schema.NO_DATA_ANSWER


def test_renamed_columns_and_rejected_values(spark, edge_csv, tmp_path):
    text = Path(edge_csv).read_text().replace("hotel,", "property,", 1).replace("lead_time", "days_ahead", 1).replace(",20,2017", ",soon,2017", 1)
    (tmp_path / "b.csv").write_text(text)
    names = {"hotel": "property", "lead_time": "days_ahead"}
    paths = workflow.build(spark, str(tmp_path / "b.csv"), str(tmp_path / "out"), names=names)
    rejected = {r["column"]: r["rejected"] for r in spark.read.parquet(paths["rejected"]).collect()}
    assert rejected["lead_time"] == 1 and sum(rejected.values()) == 1
    found = stores.load_insights(spark, paths["insights"]).where("category = 'revenue_by_hotel'").collect()
    assert {r.subkey for r in found} == {"City Hotel", "Resort Hotel"}
    with pytest.raises(ValueError, match="lack the columns"):
        workflow.build(spark, str(tmp_path / "b.csv"), str(tmp_path / "out"))


def test_answers_with_times(spark):
    described = spark.createDataFrame(
        [("1", "yes", True, None, None), ("2", "no", True, None, None)],
        "question_id string, raw_answer string, has_relevant_info boolean, graph string, graph_description string",
    )
    log = spark.createDataFrame([("1", "2024-01-01 00:00:00", "2024-01-01 00:00:01.5")], "question_id string, started_at string, ended_at string")
    out = {r.question_id: r for r in workflow.answers(described, log).collect()}
    assert out["1"].answer == "yes\n\n(Response time: 1.50 seconds)" and out["1"].response_time == 1.5
    assert out["2"].answer == "no" and out["2"].response_time is None
    assert list(out["1"].asDict()) == [f.name for f in schema.ANSWERS]


def test_chart_series(clean):
    rows = H.chart_series(I.booking_rollup(clean).cache()).collect()
    series = {}
    for r in rows:
        series.setdefault(r.chart, {})[r.label] = r.value
    assert set(series) == set(schema.CHART_DESCRIPTIONS)
    assert series["top_countries"] == {"GBR": 3, "ESP": 2, "PRT": 2}
    assert series["monthly_revenue"]["2017-06-30 00:00:00"] == 0
    assert len(series["lead_time_distribution"]) == 20 and sum(series["lead_time_distribution"].values()) == 7


def test_sample_questions(clean):
    assert Q.revenue_of_month(clean, 2017, 7).first()[0] == 765.75
    assert Q.revenue_of_month(clean, 2016, 1).first()[0] == 0
    assert [tuple(r) for r in Q.cancellations_by_country(clean).collect()] == [("ESP", 1), ("GBR", 1), ("PRT", 1)]
    assert Q.average_booking_price(clean).first()[0] == 525.75 / 7
    assert tuple(Q.cancellation_rate_of_hotel(clean, "City Hotel").first()) == ("City Hotel", 0.5)
    assert Q.top_segment_by_bookings(clean).first().market_segment == "Direct"
    assert tuple(Q.top_segment_by_cancellation(clean).first()) == ("Groups", 1.0)
    assert [r.revenue for r in Q.monthly_revenue_trend(clean).collect()] == [120.0, 0.0, 765.75, 0.0, 843.5]
    assert [r.lead_time_bin for r in Q.lead_time_and_cancellation(clean).collect()] == list(schema.LEAD_TIME_LABELS)
    assert tuple(Q.top_customer_type_by_revenue(clean).first()) == ("Contract", 843.5)
    assert Q.average_stay_of_hotel(clean, "Resort Hotel").first()[0] == 11 / 3


def test_columns_beyond_the_standard_ones_count_for_copies(spark, tmp_path):
    lines = EDGE_CSV.strip().split("\n")
    extra = [lines[0] + ",note"] + [f"{line},{i}" for i, line in enumerate(lines[1:])]
    (tmp_path / "b.csv").write_text("\n".join(extra) + "\n")
    paths = workflow.build(spark, str(tmp_path / "b.csv"), str(tmp_path / "out"))
    back = stores.load_insights(spark, paths["insights"])
    assert back.where((F.col("category") == "lead_time_stats") & (F.col("subkey") == "count")).first().value == 8

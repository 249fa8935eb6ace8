"""Registered queries: same rows as their SQL, and the plans they are meant to have."""

from __future__ import annotations

import re

import check
import pytest

import __spark_entry__ as entry
from roomledger import schema
from roomledger.plans import oracle, registry

FOLDER = "/root/testdata/sf0.001"
NAMES = list(registry.QUERIES)


@pytest.fixture(scope="module")
def db():
    return check.connect(FOLDER)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_every_query_has_sql():
    assert set(oracle.ORACLE_SQL) == set(NAMES)
    assert set(entry.queries()) >= set(NAMES) and set(entry.oracle_sql()) >= set(NAMES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert {r.category for r in df.collect()} == set(schema.CATEGORIES)


@pytest.mark.parametrize("name", NAMES)
def test_rows_and_plan(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    text = plan(df)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in text
    assert check.differences(df, db, entry.oracle_sql()[name]) == ""


def test_top_n_without_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["top_countries"](spark, FOLDER))


def test_neighbours_are_cut_before_the_last_shuffle(spark):
    text = plan(entry.queries()["knn_top5_by_cells"](spark, FOLDER))
    assert "WindowGroupLimit" in text
    assert "Exchange" not in plan(entry.queries()["knn_top5"](spark, FOLDER))


def test_only_needed_columns_are_read(spark):
    text = plan(entry.queries()["evaluate_latency"](spark, FOLDER))
    assert re.findall(r"ReadSchema: struct<(.*?)>", text)[0] == "ts:timestamp_ntz,value:double"


def test_rollup_reads_the_bookings_once(spark):
    from roomledger.operators import insights as I

    text = I.booking_rollup(registry.clean_bookings(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    main = text.split("Subquery subquery")[0]
    assert main.count("Expand") == 1

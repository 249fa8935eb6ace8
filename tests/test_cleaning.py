from __future__ import annotations

import datetime

import pytest
from conftest import pairs
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roomledger import schema
from roomledger.functions import columns as X
from roomledger.operators import cleaning as C


def test_fill_values_come_from_all_rows(edge):
    values = C.fill_values(edge, ("children", "agent", "company"), ("country",)).first()
    assert tuple(values) == (0.7142857142857143, 5.8, 13.333333333333334, "GBR")


def test_several_mode_columns_with_ties(spark):
    df = spark.createDataFrame(
        [("b", "y", 1.0), ("a", "z", None), ("b", None, 3.0), ("a", "z", 5.0), (None, None, None), (None, None, None)],
        "p string, q string, v double",
    )
    assert tuple(C.fill_values(df, ("v",), ("p", "q")).first()) == (3.0, "a", "z")
    filled = C.impute(df, ("v",), ("p", "q"))
    assert filled.columns == df.columns
    assert sorted(filled.collect()) == sorted(
        [("b", "y", 1.0), ("a", "z", 3.0), ("b", "z", 3.0), ("a", "z", 5.0), ("a", "z", 3.0), ("a", "z", 3.0)]
    )


def test_columns_without_values_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "v double, c string")
    assert C.impute(df, ("v",), ("c",)).collect() == [(None, None)] * 2
    assert C.impute(df.where("false"), ("v",), ("c",)).count() == 0
    assert C.impute(df, (), ()).count() == 2 and C.fill_values(df, ("v",), ("c",), "n").first().n == 2
    assert C.impute_mean(df, ("v",)).count() == 2 and C.impute_mode(df, ("c",)).count() == 2


def test_copies_are_compared_after_filling(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 2.0), (2, 2.0)], "k int, v double")
    assert sorted(C.drop_copies(C.impute_mean(df, ("v",))).collect()) == [(1, 2.0), (2, 2.0)]


def test_one_row_may_be_a_third_of_all(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"), F.lit("t").alias("t"))
    assert C.drop_copies(df).count() == 20_001


@pytest.mark.parametrize("most_digests", [C.MOST_DIGESTS, 0])
def test_copies_are_compared_in_full(spark, monkeypatch, most_digests):
    monkeypatch.setattr(C, "BITMAP_BITS", 1 << 16)
    nan = float("nan")
    rows = [(1.0, 0.0, None, "a", [1]), (1.0, -0.0, None, "a", [1]), (nan, 1.0, "x", None, None), (nan, 1.0, None, "x", None), (nan, 1.0, "x", None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c string, d string, e array<int>")
    assert sorted(map(repr, C.drop_copies(df, most_digests).collect())) == sorted(map(repr, df.dropDuplicates().collect()))
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(7).cast("long"))  # all digests collide
    many = spark.range(100).select((F.col("id") % 60).alias("k"))
    assert sorted(r.k for r in C.drop_copies(many, most_digests).collect()) == list(range(60))


def test_only_copies_move(spark):
    wide = lambda n, copies: spark.range(n).select((F.col("id") % (n - copies)).alias("k"), F.repeat(F.lit("x"), F.lit(300)).alias("t"))
    for copies in (0, 40):
        out = C.drop_copies(wide(4000, copies))
        assert out.count() == 4000 - copies
        text = out._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange hashpartitioning" in text) == bool(copies)
    moved = wide(4000, 40).transform(C.drop_copies)
    moved.collect()
    # The rows that reach the comparison in full: the two of each copied row, whatever the table's size.
    plan = moved._jdf.queryExecution().executedPlan()
    assert _rows_shuffled(plan) <= 80


def _rows_shuffled(plan) -> int:
    """Rows written by the shuffles of a finished plan."""
    final = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    total, waiting = 0, [final]
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            waiting.append(node.plan())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return total


def test_cleaning_of_few_and_of_many_rows_agrees(edge, monkeypatch):
    few = sorted(C.clean_bookings(edge).collect(), key=repr)
    monkeypatch.setattr(C, "FEW_ROWS", 3)
    assert sorted(C.clean_bookings(edge).collect(), key=repr) == few and len(few) == 7


def test_columns_that_have_no_digest(spark):
    df = spark.sql("select map('a', 1) as m union all select map('a', 1)")
    assert C.drop_copies(df.select(F.map_keys("m").alias("k"), F.lit(None).alias("nothing"))).count() == 1
    assert C.drop_copies(spark.range(5).where("id < 0")).count() == 0


def dates(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "reservation_status_date string")


@pytest.mark.parametrize(
    "texts,form",
    [
        (("2017-07-04", None), "yyyy-MM-dd"), (("04.07.2017", "01.01.2016"), "dd.MM.yyyy"), (("04/07/2017", "13/07/2017"), "dd/MM/yyyy"),
        (("1/13/2017", "12/1/2017"), "M/d/yyyy"), (("20170104",), "yyyyMMdd"), (("07/07/2017", "08/08/2017"), "MM/dd/yyyy"), ((None,), "yyyy-MM-dd"),
    ],
)
def test_date_formats_are_found(spark, texts, form):
    df = dates(spark, *texts)
    assert C.date_format_of(df, "reservation_status_date") == form
    assert C.parse_status_date(df, schema.INFERRED_FORMAT).count() == len(texts)


def test_dates_that_fit_no_format_or_several(spark):
    with pytest.raises(ValueError, match="fit several formats.*MM/dd/yyyy.*dd/MM/yyyy"):
        C.parse_status_date(dates(spark, "01/02/2017", "03/03/2017"), schema.INFERRED_FORMAT)
    with pytest.raises(ValueError, match="no date format fits.*soon"):
        C.parse_status_date(dates(spark, "2017-01-01", "soon"), schema.INFERRED_FORMAT)
    with pytest.raises(ValueError, match="no date format fits"):
        C.parse_status_date(dates(spark, "2017-01-01", "01.01.2017"), schema.INFERRED_FORMAT)


def test_clean_edge_table(clean):
    rows = clean.collect()
    assert len(rows) == 7
    assert {r.lead_time: r.lead_time_bin for r in rows} == {
        0: None, 20: "Short", 30: "Short", 31: "Medium", 90: "Medium", 180: "Long", 181: "Very Long",
    }
    by_lead = {r.lead_time: r for r in rows}
    assert by_lead[90].arrival_date is None and by_lead[90].country == "GBR"
    assert by_lead[31].arrival_date == datetime.date(2017, 9, 15)
    assert by_lead[31].reservation_status_date == datetime.date(2017, 9, 22)
    assert (by_lead[31].total_stays, by_lead[31].total_revenue) == (7, 843.5)


def test_cleaning_is_idempotent(edge, clean):
    again = C.clean_bookings(clean.select(*edge.columns).withColumn("reservation_status_date", F.col("reservation_status_date").cast("string")))
    assert sorted(again.collect(), key=repr) == sorted(clean.collect(), key=repr)


def test_missing_parts_give_missing_results(booking):
    row = C.derive_columns(booking({"arrival_date_year": 2017, "arrival_date_day_of_month": 3, "stays_in_week_nights": 2, "adr": 9.0})).first()
    assert (row.total_stays, row.arrival_date, row.total_revenue, row.lead_time_bin) == (None,) * 4


def test_bin_edges(spark):
    days = spark.createDataFrame([(d,) for d in (-1, 0, 1, 30, 31, 90, 91, 180, 181, 10_000, None)], "d int")
    labels = [r[0] for r in days.select(X.bin_label(F.col("d"))).collect()]
    assert labels == [None, None, "Short", "Short", "Medium", "Medium", "Long", "Long", "Very Long", "Very Long", None]
    own = days.select("d", X.bin_label(F.col("d"), (-5, 30), ("low", "high")).alias("b"))
    assert pairs(own, "d", "b")[0] == "low" and pairs(own, "d", "b")[31] == "high"


def test_calendar_dates(spark):
    rows = [
        (2017, "July", 31, "2017-07-31"), (2017, "july", 3, "2017-07-03"), (2016, "February", 29, "2016-02-29"),
        (2015, "February", 29, None), (2017, "April", 31, None), (2017, "Jul", 1, None), (2017, "May", 0, None),
        (2017, "May", -1, None), (None, "May", 1, None), (2017, None, 1, None), (2017, "May", None, None),
        (99999, "May", 1, None), (17, "May", 1, None), (2017, "December", 31, "2017-12-31"),
    ]
    df = spark.createDataFrame(rows, "y int, m string, d int, expected string")
    found = df.select("expected", X.calendar_date(F.col("y"), F.col("m"), F.col("d")).cast("string")).collect()
    assert all(expected == date for expected, date in found)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_bad_status_date_stops_the_job(spark, booking, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert C.parse_status_date(booking({"reservation_status_date": None})).first().reservation_status_date is None
        with pytest.raises(PySparkException, match="not a yyyy-MM-dd date"):
            C.parse_status_date(booking({"reservation_status_date": "2017-13-01"})).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("junk", ["2017", "2017-07-04 junk", "2017-7-4", "04.07.2017", ""])
def test_only_whole_dates_are_dates(spark, booking, junk):
    with pytest.raises(PySparkException, match="not a yyyy-MM-dd date"):
        C.parse_status_date(booking({"reservation_status_date": junk})).collect()


def test_another_date_format(spark):
    rows = spark.createDataFrame([("04.07.2017",), (None,)], "t string").select(X.strict_date(F.col("t"), "dd.MM.yyyy"))
    assert [r[0] for r in rows.collect()] == [datetime.date(2017, 7, 4), None]


def test_equal_dates_are_combined_before_they_are_parsed(spark, monkeypatch):
    plans = []
    first = type(spark.range(1)).first
    monkeypatch.setattr(type(spark.range(1)), "first", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or first(df))
    dates = spark.range(1000).selectExpr("if(id = 7, null, concat('2017-07-', 10 + id % 3)) as day")
    assert C.date_format_of(dates, "day") == "yyyy-MM-dd"
    assert [line.lstrip(" +-").split(" ")[0] for line in plans[0].splitlines()].count("Aggregate") == 2
    with pytest.raises(ValueError, match="no date format fits"):
        C.date_format_of(dates.selectExpr("replace(day, '11', 'x') as day"), "day")

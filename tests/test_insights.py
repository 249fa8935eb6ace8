from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from conftest import pairs
from pyspark.sql import functions as F

from roomledger import schema
from roomledger.operators import cleaning as C
from roomledger.operators import describe as D
from roomledger.operators import insights as I

MONTHS = {
    "2017-05-31 00:00:00": 120.0,
    "2017-06-30 00:00:00": 0.0,
    "2017-07-31 00:00:00": 765.75,
    "2017-08-31 00:00:00": 0.0,
    "2017-09-30 00:00:00": 843.5,
}
STAYS = dict(zip(schema.DESCRIBE_LABELS, (7, 2.857142857142857, 2.2677868380553634, 0, 1.5, 3.0, 3.5, 7)))
LEADS = dict(zip(schema.DESCRIBE_LABELS, (7, 76.0, 76.47439658691877, 0, 25.0, 31.0, 135.0, 181)))


def test_single_insights(clean):
    assert pairs(I.monthly_revenue(clean), "month_end", "revenue") == MONTHS
    assert pairs(I.revenue_by_hotel(clean), "hotel", "avg_revenue") == {"City Hotel": 181.4375, "Resort Hotel": 334.5}
    assert pairs(I.revenue_by_room(clean), "reserved_room_type", "avg_revenue") == {"A": 153.15, "B": 120.0, "D": 843.5}
    assert pairs(I.revenue_by_segment(clean), "market_segment", "avg_revenue") == {
        "Direct": 230.0, "Groups": 112.875, "Online TA": 461.75,
    }
    assert I.overall_cancellation_rate(clean).first()[0] == 42.857142857142854
    assert pairs(I.cancellation_by_hotel(clean), "hotel", "cancellation_rate") == {"City Hotel": 0.5, "Resort Hotel": 1 / 3}
    assert pairs(I.cancellation_by_channel(clean), "market_segment", "cancellation_rate") == {
        "Direct": 0.0, "Groups": 1.0, "Online TA": 0.5,
    }
    assert [tuple(r) for r in I.cancellation_by_lead_time(clean).orderBy("bin_no").collect()] == [
        (0, "Short", 1.0), (1, "Medium", 0.5), (2, "Long", 0.0), (3, "Very Long", 0.0),
    ]
    assert [tuple(r) for r in I.top_countries(clean).collect()] == [("GBR", 3), ("ESP", 2), ("PRT", 2)]
    assert pairs(I.adr_by_customer_type(clean), "customer_type", "avg_adr") == {
        "Contract": 120.5, "Group": 50.0, "Transient": 70.0, "Transient-Party": 75.25,
    }
    assert pairs(I.booking_channel_percentage(clean), "market_segment", "booking_pct") == pytest.approx(
        {"Direct": 100 / 3, "Groups": 100 / 3, "Online TA": 100 / 3}
    )
    assert pairs(I.lead_time_stats(clean), "subkey", "value") == LEADS
    assert pairs(I.length_of_stay_stats(clean), "subkey", "value") == STAYS


def test_histogram(spark, clean):
    rows = I.lead_time_histogram(clean).orderBy("bin").collect()
    assert {r.bin: r["count"] for r in rows if r["count"]} == {0: 1, 2: 1, 3: 2, 9: 1, 19: 2}
    assert len(rows) == 20 and rows[0].bin_start == 0 and rows[-1].bin_end == 181
    same = spark.createDataFrame([(5,)] * 3 + [(None,)], "lead_time int")
    rows = I.lead_time_histogram(same).orderBy("bin").collect()
    expected, edges = np.histogram([5, 5, 5], bins=20)
    assert [r["count"] for r in rows] == list(expected)
    assert [r.bin_start for r in rows] == pytest.approx(list(edges[:-1]))
    assert [r["count"] for r in I.lead_time_histogram(same.where("lead_time is null")).collect()] == [0] * 20


def test_histogram_against_numpy(spark):
    random.seed(4)
    days = [random.choice((0, 7, random.randint(-50, 700))) for _ in range(3000)]
    df = spark.createDataFrame([(d,) for d in days], "lead_time int")
    for bins in (20, 7):
        expected = [0] * bins
        for d in days:
            expected[min((d - min(days)) * bins // (max(days) - min(days)), bins - 1)] += 1
        rows = I.lead_time_histogram(df, bins).orderBy("bin").collect()
        assert [r["count"] for r in rows] == expected and sum(expected) == 3000


@pytest.mark.parametrize("span", [3, 400, 2_000_000])
def test_describe_against_brute_force(spark, span):
    random.seed(span)
    days = [random.randint(-span, span) for _ in range(4001)] + [span // 2] * 2000
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "d int")
    found = pairs(D.describe_column(df, "d"), "subkey", "value")
    assert found["count"] == len(days)
    assert found["mean"] == pytest.approx(statistics.fmean(days), rel=1e-12)
    assert found["std"] == pytest.approx(statistics.stdev(days), rel=1e-12)
    assert (found["min"], found["max"]) == (min(days), max(days))
    for label, p in D.QUARTILES.items():
        assert found[label] == np.quantile(days, p)


def test_describe_few_values(spark):
    df = spark.createDataFrame([(4,), (None,)], "d int")
    one = pairs(D.describe_column(df, "d"), "subkey", "value")
    assert one == {"count": 1, "mean": 4, "std": None, "min": 4, "25%": 4, "50%": 4, "75%": 4, "max": 4}
    none = pairs(D.describe_column(df.where("d is null"), "d"), "subkey", "value")
    assert none.pop("count") == 0 and set(none.values()) == {None}


def test_all_insights_agree_with_single_ones(clean):
    rows = I.insights_long(clean).collect()
    long = {}
    for r in rows:
        long.setdefault(r.category, {})[r.subkey] = r.value
    assert set(long) == set(schema.CATEGORIES) and sum(map(len, long.values())) == len(rows)
    assert long["monthly_revenue"] == MONTHS
    assert long["lead_time_stats"] == LEADS and long["length_of_stay_stats"] == STAYS
    assert long["overall_cancellation_rate"] == {None: 42.857142857142854}
    for name, step, key, value in (
        ("revenue_by_hotel", I.revenue_by_hotel, "hotel", "avg_revenue"),
        ("revenue_by_room", I.revenue_by_room, "reserved_room_type", "avg_revenue"),
        ("revenue_by_segment", I.revenue_by_segment, "market_segment", "avg_revenue"),
        ("cancellation_by_hotel", I.cancellation_by_hotel, "hotel", "cancellation_rate"),
        ("cancellation_by_channel", I.cancellation_by_channel, "market_segment", "cancellation_rate"),
        ("cancellation_by_lead_time", I.cancellation_by_lead_time, "lead_time_bin", "cancellation_rate"),
        ("top_countries", I.top_countries, "country", "bookings"),
        ("booking_channel_percentage", I.booking_channel_percentage, "market_segment", "booking_pct"),
        ("adr_by_customer_type", I.adr_by_customer_type, "customer_type", "avg_adr"),
    ):
        assert long[name] == pairs(step(clean), key, value), name


def test_insights_of_an_empty_table(booking):
    empty = C.clean_bookings(booking().where("false"))
    long = {(r.category, r.subkey): r.value for r in I.insights_long(empty).collect()}
    assert long.pop(("lead_time_stats", "count")) == 0 and long.pop(("length_of_stay_stats", "count")) == 0
    assert set(long.values()) == {None}
    assert {k for c, k in long if c == "cancellation_by_lead_time"} == set(schema.LEAD_TIME_LABELS)
    assert ("overall_cancellation_rate", None) in long and not any(c == "monthly_revenue" for c, _ in long)


def test_missing_keys_and_values(booking):
    df = C.derive_columns(
        booking(
            {"hotel": "A", "is_canceled": 1, "adr": 10.0, "stays_in_weekend_nights": 1, "stays_in_week_nights": 0},
            {"hotel": "A", "is_canceled": None, "lead_time": 10, "market_segment": "Direct"},
            {"hotel": None, "is_canceled": 0, "adr": 4.0, "market_segment": "Direct", "country": "PRT", "lead_time": 10},
        )
    )
    long = {(r.category, r.subkey): r.value for r in I.insights_long(df).collect()}
    assert long["revenue_by_hotel", "A"] == 10.0 and long["cancellation_by_hotel", "A"] == 1.0
    assert long["overall_cancellation_rate", None] == pytest.approx(100 / 3)
    assert long["top_countries", "PRT"] == 0  # counts hotels, and this row has none
    assert long["booking_channel_percentage", "Direct"] == 100.0
    assert long["revenue_by_segment", "Direct"] is None
    assert long["cancellation_by_lead_time", "Short"] == 0.0 and long["cancellation_by_lead_time", "Long"] is None


def test_month_gap_over_a_year_end(spark):
    monthly = spark.sql("select date'2019-11-01' as month, 5 as v union all select date'2020-02-01', 7")
    rows = I.fill_month_gaps(monthly, "v").orderBy("month").collect()
    assert [(str(r.month), r.v) for r in rows] == [("2019-11-01", 5), ("2019-12-01", 0), ("2020-01-01", 0), ("2020-02-01", 7)]


def test_revenue_is_kept_by_month(clean):
    total = clean.where("arrival_date is not null").agg(F.sum("total_revenue")).first()[0]
    assert I.monthly_revenue(clean).agg(F.sum("revenue")).first()[0] == total


def test_fractions_are_refused_and_not_cut(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (None,)], "d double")
    assert pairs(D.describe_column(rows, "d"), "subkey", "value")["mean"] == 1.5
    for bad in (2.9, 3e10):
        more = rows.unionByName(spark.createDataFrame([(bad,)], "d double"))
        with pytest.raises(Exception, match="no 32-bit whole number"):
            D.value_counts(more, "d").collect()
        assert pairs(D.describe_column(more, "d"), "subkey", "value")["max"] == bad

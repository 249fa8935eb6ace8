"""Statistics and histograms of real numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomledger.operators import describe as D

RANDOM = np.random.default_rng(3)
COLUMNS = {
    "spread over all magnitudes": np.concatenate([RANDOM.normal(size=300) * 10.0 ** RANDOM.integers(-300, 140, 300), [0.0, -0.0]]),
    "money": np.round(RANDOM.normal(100, 30, 999), 2),
    "few values": RANDOM.choice([0.1, 0.2, -0.3], 1000),
    "a third equal": np.concatenate([np.full(333, 7.25), RANDOM.normal(size=667)]),
    "one": np.array([2.5]),
    "two": np.array([1.5, -2.5]),
    "equal": np.full(10, 0.1),
    "tiny steps": 1.0 + np.arange(50) * np.finfo(float).eps,
    "negative": -np.abs(RANDOM.normal(size=64)),
}


def frame(spark, values):
    rows = [(None,), (float("nan"),)] + [(float(v),) for v in values]
    return spark.createDataFrame(rows, "x double")


@pytest.mark.parametrize("name", COLUMNS)
def test_against_plain_statistics(spark, name):
    values = COLUMNS[name]
    found = {r.subkey: r.value for r in D.describe_column(frame(spark, values), "x").collect()}
    with np.errstate(all="ignore"):
        expected = pd.Series(values).describe().to_dict()
    assert set(found) == set(expected)
    for key, value in expected.items():
        if np.isnan(value):
            assert found[key] is None
        elif key in ("count", "min", "max"):
            assert found[key] == value
        else:
            assert found[key] == pytest.approx(value, rel=1e-12, abs=1e-15), key


def test_keys_order_as_the_values_do(spark):
    values = sorted([-np.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1e-10, 2.0, np.inf])
    keys = [r.key for r in spark.createDataFrame([(float(v),) for v in values], "x double").select(D.order_key("x").alias("key")).collect()]
    assert keys == sorted(keys) and [D.value_of_key(k) for k in keys] == values
    table = spark.createDataFrame([(k,) for k in keys for _ in range(3)], "key long")
    assert D.keys_at(table, range(27)) == {i: keys[i // 3] for i in range(27)}


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in ("spread over all magnitudes",)])
def test_bins_against_numpy(spark, name):
    values = COLUMNS[name]
    counts, edges = np.histogram(values, bins=20)
    rows = sorted(D.histogram_of_column(frame(spark, values), "x").collect())
    assert [r.bin for r in rows] == list(range(20)) and [r["count"] for r in rows] == counts.tolist()
    assert [r.bin_start for r in rows] + [rows[-1].bin_end] == edges.tolist()


def test_values_on_the_edges(spark):
    values = np.linspace(0.1, 0.9, 21)
    counts, _ = np.histogram(values, bins=20)
    rows = sorted(D.histogram_of_column(frame(spark, values), "x").collect())
    assert [r["count"] for r in rows] == counts.tolist()


def test_decimals_empty_columns_and_infinite_values(spark):
    money = frame(spark, [1.25, 2.5]).select(F.nanvl("x", F.lit(None).cast("double")).cast("decimal(10,2)").alias("x"))
    assert {r.subkey: r.value for r in D.describe_column(money, "x").collect()}["mean"] == 1.875
    empty = frame(spark, [])
    assert {r.subkey: r.value for r in D.describe_column(empty, "x").collect()} == {
        "count": 0.0, "mean": None, "std": None, "min": None, "25%": None, "50%": None, "75%": None, "max": None,
    }
    assert [r["count"] for r in D.histogram_of_column(empty, "x").collect()] == [0] * 20
    with pytest.raises(ValueError, match="too far apart"):
        D.histogram_of_column(frame(spark, [np.inf, 1.0]), "x")


def test_a_round_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(D, "ROUND_BITS", 5)
    values = COLUMNS["money"]
    found = {r.subkey: r.value for r in D.describe_column(frame(spark, values), "x").collect()}
    assert found["50%"] == float(np.median(values))

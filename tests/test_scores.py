"""Each part of the composite scores changes a result, by hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom.operators import aggregates
from feedloom.plans import composites

NOW = dt.datetime(2024, 3, 15)
DAY = dt.timedelta(days=1)


def lit(t):
    return F.lit(t.isoformat(sep=" ")).cast("timestamp")


@pytest.fixture(scope="module")
def macro(spark):
    return spark.createDataFrame([("Energy", "Oil & Gas", 1.1)], "sector_name string, industry_name string, multiplier double")


def scores(spark, macro, symbol, articles, signals=(), **changed):
    row = {"id": 1, "industry": "oil", "status": True, "ai_multiplier": None, "last_10k_filed": NOW - DAY} | symbol
    symbols = spark.createDataFrame([tuple(row.values())], "id long, industry string, status boolean, ai_multiplier double, last_10k_filed timestamp")
    rows = spark.createDataFrame([(1, f, s, t) for f, s, t in articles], "symbol_id long, form_type string, score double, published_at timestamp")
    given = spark.createDataFrame([(1, m, t, a) for m, t, a in signals], "symbol_id long, modifier double, filed_at timestamp, is_active boolean")
    plain = composites.final_scores(symbols, rows, macro, lit(NOW)).collect()
    full = composites.final_scores_with_signals(symbols, rows, macro, given, lit(NOW)).collect()
    return [r["final_score"] for r in plain], [r["final_score"] for r in full]


def test_stored_multiplier_and_status(spark, macro):
    news = [(None, 0.5, NOW - DAY)]
    assert scores(spark, macro, {}, news) == ([0.55], [0.55])
    assert scores(spark, macro, {"ai_multiplier": 1.2}, news) == ([0.66], [0.66])
    assert scores(spark, macro, {"status": False}, news) == ([], [])
    assert scores(spark, macro, {"industry": None}, [*news, (None, 0.9, None), (None, 0.1, NOW)]) == ([0.5], [0.5])


def test_weights_of_the_registry(spark, macro):
    rows = [("10-Q", 0.8, NOW - DAY), (None, 0.2 + 0.1, NOW - DAY)]
    plain, full = scores(spark, macro, {"industry": ""}, rows)
    assert (plain, full) == ([0.55], [round((0.8 * 2 + 0.3) / 3, 6)])


def test_late_report_and_active_signals(spark, macro):
    news = [(None, 0.5, NOW - DAY)]
    signals = [(0.05, NOW - DAY, True), (0.05, NOW - DAY, False), (0.05, NOW - 180 * DAY, True), (0.05, NOW - 179 * DAY, True)]
    assert scores(spark, macro, {"industry": ""}, news, signals)[1] == [0.6]
    for late in (None, NOW - 548 * DAY):
        assert scores(spark, macro, {"industry": "", "last_10k_filed": late}, news, signals)[1] == [0.54]


def test_unscored_amendments_block(spark, macro):
    news = (None, 0.5, NOW - DAY)
    assert scores(spark, macro, {}, [news, ("10-K/A", None, NOW)]) == ([0.55], [None])
    assert scores(spark, macro, {}, [news, ("8-K", None, NOW)])[1] == [0.55]
    rows = spark.createDataFrame([(1, "10-Q/A", None), (1, "10-K", 0.1)], "symbol_id long, form_type string, score double")
    assert aggregates.tier1_coverage_guard(rows).first()["blocked"] is False

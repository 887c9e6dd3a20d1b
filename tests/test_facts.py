import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import facts, filings


def test_figures_of_every_shape(spark):
    rows = [
        (1, json.dumps({"financial_figures": [{"metric": " Total Revenue", "value": "$1.2B", "period": "Q1"}, {"metric": "revenue", "value": "5M"}, {"metric": "_note", "value": "1"}]})),
        (2, json.dumps({"financial_figures": {"Revenue": "850K", "margin": "n/a"}})),
        (3, json.dumps({"revenue": "3M", "headcount": "10"})),
        (4, None),
        (5, "broken"),
    ]
    got = {(r.id, r.key): r.amount for r in facts.extract_figures(spark.createDataFrame(rows, "id int, j string"), "j", ["revenue", "margin"]).collect()}
    assert got == {(1, "revenue"): 1200.0, (2, "revenue"): pytest.approx(0.85), (3, "revenue"): 3.0}


def test_model_json(spark):
    answers = ['```json\n{"a": 1}\n```', 'so {"a": {"b": 2}} end', '{"a": [1, 2', '{"a": "x', "none", None]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, t string")
    got = [r.x for r in df.select("i", facts.model_json("t").alias("x")).orderBy("i").collect()]
    assert [json.loads(x) if x else None for x in got] == [{"a": 1}, {"a": {"b": 2}}, {"a": [1, 2]}, {"a": "x"}, None, None]


def test_sections_titles_and_reports(spark):
    body = "\n".join(["UNITED STATES", "x", "y", "z", "w", "The Company Announces Very Good Results", "Item 2.02 Results", "grew", "SIGNATURES"])
    df = spark.createDataFrame([(1, body), (2, "short")], "id int, t string")
    assert {r.id: r.x for r in df.select("id", facts.filing_title("t", F.lit("?")).alias("x")).collect()} == {1: "The Company Announces Very Good Results", 2: "?"}
    assert [(r.id, r.section, r.body) for r in filings.eight_k_items(df, "t", ["2.02", "5.02"], whole=20).orderBy("id").collect()] == [(1, "2.02", "Item 2.02 Results\ngrew"), (2, "whole", "short")]
    deals = spark.createDataFrame([(1, "P", "purchase", 10.0, 2.0, 20.0), (1, "S", "sale", 1.0, 3.0, 3.0)], "id int, code string, kind string, shares double, price double, value double").withColumn("traded_at", F.to_date(F.lit("2024-01-02")))
    (row,) = facts.form4_text(deals, "id").collect()
    assert (row.bought, row.sold, row.n_transactions) == (20.0, 3.0, 2) and row.report.startswith("2024-01-02 purchase")


def test_violations_and_hook(spark):
    rows = [(1, "s" * 120, 0.5, "c", "f", "p" * 400), (2, "short", 2.0, None, " ", "p" * 400), (3, None, None, None, None, None), (4, "short", 0.0, None, "f", None)]
    df = spark.createDataFrame(rows, "id int, summary string, score double, calibration string, forecast string, former string")
    got = {r.id: r.v for r in df.select("id", facts.violations("summary", "score", "calibration", "forecast", F.col("former")).alias("v")).collect()}
    assert got == {1: [], 2: ["summary", "score", "calibration", "forecast"], 3: ["summary", "score", "forecast"], 4: []}
    hooked = facts.score_articles(df.select("id"), lambda b: b.assign(score=b.id * 0.1), "id int, score double")
    assert sorted(r.score for r in hooked.collect()) == pytest.approx([0.1, 0.2, 0.3, 0.4])


def test_clean_numbers_at_any_depth(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")], {"a": float("inf"), "b": 2.0}, (float("nan"), "t"), 3)], "id int, l array<double>, m map<string,double>, s struct<x:double,y:string>, n int")
    (r,) = facts.clean_numbers(df, ["l", "m", "s", "n"]).collect()
    assert r.l == [1.0, None] and r.m == {"a": None, "b": 2.0} and (r.s.x, r.s.y) == (None, "t") and r.n == 3

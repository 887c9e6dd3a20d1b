"""Scans slice by slice against plain windows, with a key that holds a third of the rows."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.operators import dedup, joins

START = dt.datetime(2023, 12, 30)


def table(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice((1, None, rng.randint(2, 6))), START + dt.timedelta(hours=rng.randint(0, 3000)) if rng.random() < 0.97 else None, rng.choice((None, None, rng.random())), rng.choice((None, f"t{i}"))) for i in range(900)]
    return spark.createDataFrame(rows, "id long, k long, at timestamp, score double, said string")


def test_carried_and_previous_values_equal_plain_windows(spark):
    df = table(spark)
    for order in (["at", "id"], ["id"], ["said", "id"]):
        columns = [F.col(c) for c in order]
        w = Window.partitionBy("k").orderBy(*columns)
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("id", *(F.last(c, ignorenulls=True).over(so_far).alias(f"last_{c}") for c in ("score", "said")), *(F.lag(c).over(w).alias(f"previous_{c}") for c in ("score", "said")))
        carried = dedup.carry_forward(df, "k", columns, ["score", "said"])
        assert carried.columns == [*df.columns, "last_score", "last_said"]
        got = carried.select("id", "last_score", "last_said").join(dedup.previous_state(df, "k", columns, ["score", "said"]).select("id", "previous_score", "previous_said"), "id")
        assert sorted(got.collect()) == sorted(want.collect())


def test_no_window_holds_the_rows_of_a_whole_key(spark):
    df = table(spark)
    for out in (dedup.carry_forward(df, "k", [F.col("at"), F.col("id")], ["score"]), dedup.previous_state(df, "k", [F.col("at"), F.col("id")], ["score"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        over_rows = [line for line in plan.splitlines() if "Window [" in line and "_slice" not in line]
        assert not over_rows
    counted = df.withColumn("s", dedup.slice_of(df, F.col("at"))).groupBy("k", "s").count()
    assert counted.agg(F.max("count")).first()[0] < 60 < df.filter("k = 1").count()


def test_asof_falls_back_to_the_symbols_own_row(spark):
    at = lambda d: START + dt.timedelta(days=d)
    left = spark.createDataFrame([(1, 1, at(5)), (2, 1, at(0)), (3, 2, at(9)), (4, 3, at(9)), (5, 1, at(400))], "id long, k long, at timestamp")
    right = spark.createDataFrame([(1, at(5), 10.0), (1, at(3), 8.0), (2, at(1), None)], "k long, day timestamp, close double")
    own = spark.createDataFrame([(1, 99.0), (2, 98.0)], "k long, close double")
    got = {r.id: (r.matched_at, r.close) for r in joins.asof_backward(left, right, "k", "at", "day", ["close"], fallback=own).collect()}
    assert got == {1: (at(5), 10.0), 2: (None, 99.0), 3: (at(1), None), 4: (None, None), 5: (at(5), 10.0)}


def test_macro_row_and_related_texts(spark):
    macro = spark.createDataFrame([("B", "Oil & Gas", 1.1, "b"), ("A", "Big Oil", 1.1, "a"), ("C", "Oil", 1.0, "c"), ("C", "Oil", None, "n")], "sector_name string, industry_name string, multiplier double, rationale string")
    symbols = spark.createDataFrame([(1, "oil", "A"), (2, "none", None), (3, None, "B"), (4, "gas", "C")], "id long, industry string, sector string")
    got = {r.id: (r.macro_multiplier, r.macro_sector, r.macro_rationale) for r in joins.macro_row_for(symbols, macro).collect()}
    assert got == {1: (1.1, "A", "a"), 2: (1.0, None, None), 3: (1.0, None, None), 4: (1.1, "B", "b")}
    research = spark.createDataFrame([(i, START + dt.timedelta(days=i), f"on {'Big Oil' if i % 2 else 'big oils'} now", "x " * 200, True) for i in range(30)], "id long, published_at timestamp, title string, summary string, llm_processed boolean")
    sectors = spark.createDataFrame([(1, "Energy"), (2, None)], "id long, sector string")
    catalog = spark.createDataFrame([("Energy", "Big Oil")], "sector_name string, industry_name string")
    related = joins.related_research(sectors, catalog, research)
    got = sorted((r.symbol_id, r.id) for r in related.collect())
    assert got == [(1, i) for i in range(15, 30, 2)] + [(2, i) for i in range(25, 30)]
    plan = related._jdf.queryExecution().optimizedPlan().toString()
    exploded = next(line for line in plan.splitlines() if "Generate explode" in line and "_word" in line)
    assert "NestedLoop" not in related._jdf.queryExecution().executedPlan().toString() and exploded

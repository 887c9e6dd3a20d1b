"""Stored streams: running state at any time, late rows, keyed stores."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedloom.operators import aggregates, upsert
from feedloom.streaming import jobs
from feedloom.streaming.store import KeyedStore

START = dt.datetime(2024, 1, 1)


def lit(t):
    return F.lit(t.isoformat(sep=" ")).cast("timestamp")


def arrivals(spark, seed, shuffled):
    """Articles of 120 days, and a batch number for each: in order, or late and early ones mixed."""
    rng = random.Random(seed)
    rows = [(i, rng.randint(1, 3), START + dt.timedelta(minutes=rng.randint(0, 120 * 1440)), rng.choice((None, 0.1, 0.3, 0.5, -0.4, -0.9)), f"s{i}") for i in range(300)]
    rows += [(900, 4, START, 0.5, "only old"), (901, 5, None, 0.5, "no time")]
    order = rng.sample(rows, len(rows)) if shuffled else sorted(rows, key=lambda r: r[2] or START)
    return [order[i : i + 60] for i in range(0, len(order), 60)]


def streamed(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i:03}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


SCHEMA = "id long, symbol_id long, published_at timestamp, score double, summary string"


@pytest.mark.parametrize("shuffled", [False, True])
def test_running_state_equals_the_decayed_mean_at_any_time(spark, tmp_path, shuffled):
    batches = arrivals(spark, 3, shuffled)
    table = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    state = jobs.run_running_state(streamed(spark, tmp_path, batches, SCHEMA)).read()
    assert state.filter("at IS NOT NULL").count() > 0 and state.filter("n_folded > 0").count() > 0
    for days in (120, 130, 150.5, 400):
        as_of = lit(START + dt.timedelta(days=days))
        want = {r.symbol_id: r for r in aggregates.decayed_mean(table, "symbol_id", "score", "published_at", as_of).collect()}
        got = {r.symbol_id: r for r in jobs.read_means(state, as_of).filter("mean_score IS NOT NULL").collect()}
        assert set(got) == set(want) == {1, 2, 3, 4}
        for k, r in got.items():
            assert r.mean_score == pytest.approx(want[k].mean_score, abs=1e-12) and (r.newest, r.n_material) == (want[k].newest, want[k].n_material)
    last = {r.symbol_id: r.last_summary for r in jobs.read_means(state, lit(START)).collect()}
    scored = [r for b in batches for r in b if r[3] is not None and r[2] is not None]
    assert last == {k: max((r for r in scored if r[1] == k), key=lambda r: (r[2], r[0]))[4] for k in (1, 2, 3, 4)}


def test_incremental_scores_in_either_order(spark, tmp_path):
    as_of, found = lit(START + dt.timedelta(days=130)), []
    for shuffled in (False, True):
        rows = jobs.run_incremental_scores(streamed(spark, tmp_path / str(shuffled), arrivals(spark, 5, shuffled), SCHEMA), as_of).collect()
        found.append({r.symbol_id: (round(r.mean_score, 9), r.n_material) for r in rows if r.mean_score is not None})
    assert found[0] == found[1] and len(found[0]) == 4


def test_late_rows_revise_buckets_and_counts(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [(1, 1, at(1), 0.1), (2, 1, at(4), 0.9), (3, 1, at(7), None), (4, 1, at(3), 0.9), (5, 2, at(2), None), (6, 1, None, 1.0), (7, 1, at(9), -0.5)]
    schema = "id long, symbol_id long, published_at timestamp, score double"
    results = []
    for i, order in enumerate(([0, 1, 2, 3, 4, 5, 6], [6, 3, 5, 4, 2, 1, 0])):
        stream = streamed(spark, tmp_path / str(i), [[rows[k]] for k in order], schema).withColumn("source_name", F.lit("s"))
        got = jobs.run_stored(stream, "buckets", ("symbol_id", "source_name", "bucket"), jobs.best_of_buckets, jobs.revise_buckets)
        results.append(sorted((r.symbol_id, r.bucket.minute, r.id) for r in got.collect()))
        kinds = stream.select(F.lit("k").alias("kind"), F.col("published_at").alias("scored_at"))
        hours = jobs.run_stored(kinds, "hours", ("kind", "hour"), jobs.hourly_counts, jobs.add_counts)
        assert [(r.kind, r.n) for r in hours.collect()] == [("k", 6)]
        assert jobs.sliding_counts(hours, 3).count() == 3
    assert results[0] == results[1] == [(1, 0, 2), (1, 5, 7), (2, 0, 5)]


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "/data/" in str(p)}


def test_store_touches_its_parts_alone_and_repeats_change_nothing(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "t"), ("k",), parts=16)
    merge = lambda old, new: new if old is None else upsert.upsert(old, new, ["k"], [F.lit(1)])
    assert store.read() is None
    store.merge(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")), 0, merge)
    before = files(tmp_path)
    batch = spark.createDataFrame([(3, "new"), (200, "new")], "k long, v string")
    touched = store.merge(batch, 1, merge)
    assert 1 <= len(touched) <= 2 and {p: t for p, t in files(tmp_path).items() if p in before} == before
    want = sorted([(k, "old") for k in range(100) if k != 3] + [(3, "new"), (200, "new")])
    assert sorted(map(tuple, store.read().collect())) == want
    held = {p: b for p, b in store.commits().items() if p not in touched}
    assert held and set(held.values()) == {0}
    assert store.merge(spark.createDataFrame([(3, "again")], "k long, v string"), 1, merge) == touched
    assert sorted(map(tuple, store.read().collect())) == want


def test_store_survives_a_crash_before_the_commit(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "t"), ("k",), parts=4)
    raised = jobs.raised(["k"])
    rows = lambda *r: spark.createDataFrame(r, "k long, multiplier double, rationale string, seq long")
    store.merge(rows((1, 1.0, "a", 0), (2, 1.0, "b", 0)).drop("seq"), 0, lambda _, new: new)
    # data of a batch that never committed, as a lost driver leaves it
    rows((1, 9.0, "lost", 0)).drop("seq").withColumn("part", F.lit(0)).write.partitionBy("part").parquet(str(tmp_path / "t/data/batch=1"))
    assert sorted(r.multiplier for r in store.read().collect()) == [1.0, 1.0]
    store.merge(rows((1, 1.2, "up", 1), (2, 0.5, "down", 1)), 1, raised)
    assert sorted(map(tuple, store.read().select("k", "multiplier", "rationale").collect())) == [(1, 1.2, "up"), (2, 1.0, "b")]


def test_a_merge_moves_each_side_once(spark, tmp_path):
    store, plans = KeyedStore(spark, str(tmp_path / "t"), ("k",), parts=4), []

    def longer(old, new):
        both = upsert.keep_longer(old, new, ["k"], "v", ["s"])
        plans.append(both._jdf.queryExecution().executedPlan().toString())
        return both

    rows = spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(0).alias("s"))
    store.merge(rows, 0, lambda _, new: new)
    store.merge(rows.filter("k % 2 = 0").withColumns({"v": F.lit("longer"), "s": F.lit(1)}), 1, longer)
    assert plans[0].count("Exchange") == plans[0].count("REPARTITION_BY_NUM") == 2
    assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in (tmp_path / "t/data/batch=1").glob("part=*"))
    assert sorted((r.k, r.v, r.s) for r in store.read().collect()) == [(i, "old" if i % 2 else "longer", 1 - i % 2) for i in range(100)]

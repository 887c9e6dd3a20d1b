"""The running state is folded by Spark's own operations, key by key for many keys at once."""

import math

import pytest
from pyspark.sql import functions as F

from feedloom.streaming import jobs


def test_state_folds_without_python_and_late_rows_count(spark):
    day = lambda n: f"timestamp'2024-01-01' + interval {n} days"
    rows = lambda *r: spark.sql(" UNION ALL ".join(f"SELECT {i}L AS id, 1L AS symbol_id, {day(d)} AS published_at, double({s}) AS score, 's{i}' AS summary" for i, d, s in r))
    first = jobs.keep_state(None, jobs.scored_rows(rows((1, 0, 0.5), (2, 50, -0.5), (3, 51, "NULL"), (4, 40, 0.1))))
    assert "Python" not in first._jdf.queryExecution().executedPlan().toString()
    (head,) = first.filter("at IS NULL").collect()
    assert (head.n_folded, head.last_id, first.filter("at IS NOT NULL").count()) == (1, 2, 1)
    second = jobs.keep_state(first, jobs.scored_rows(rows((5, 1, 0.9), (6, 2, "NULL"))))
    (head,) = second.filter("at IS NULL").collect()
    assert (head.n_folded, head.last_id, second.filter("at IS NOT NULL").count()) == (2, 2, 1)
    third = jobs.keep_state(second, jobs.scored_rows(rows((7, 100, 0.3))))
    (mean,) = jobs.read_means(third, F.lit("2024-04-20").cast("timestamp")).collect()
    assert (mean.n_material, mean.last_summary) == (4, "s7")
    # articles of 110, 109, 60 and 10 days, the grace being 730.56 hours
    weights = [(s, math.exp(-0.0007 * max(0, 24 * d - 730.56))) for s, d in ((0.5, 110), (0.9, 109), (-0.5, 60), (0.3, 10))]
    assert mean.mean_score == pytest.approx(sum(s * w for s, w in weights) / sum(w for _, w in weights), abs=1e-9)

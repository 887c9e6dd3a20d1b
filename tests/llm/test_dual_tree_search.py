import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from feedloom.llm import dual_tree_search as search

from .conftest import SF

RUN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    """Every item against every document, by the definition."""
    held = [(i, Counter(RUN.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // total
            score = 0
            for t in RUN.findall((text or "").translate(LOWER)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({search.ORACLE_SQL})").fetchall()
    assert len(want) > 500
    assert rows(search.op11_dual_tree_search(spark, SF)) == sorted(want, key=repr)


@pytest.mark.parametrize("most", [600, 1 << 22])
def test_equals_the_definition_in_blocks_of_any_size(spark, documents, most):
    docs = [tuple(r) for r in documents.select("doc_id", "text").limit(60).collect()]
    items = [(n, " ".join((t or "").split()[3 * n : 3 * n + 25])) for n, (_, t) in enumerate(docs[:12])] + [(90, None), (91, "?! ."), (92, "nowhere_to-be found")]
    got = search.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4, most=most)
    assert rows(got) == plain(docs, items, 4)


def test_ties_nulls_repeats_and_clashing_columns(spark, tricky):
    items = spark.createDataFrame([(1, "alpha beta one", 5), (1, "alpha beta one", 5), (2, None, 5), (None, "WORD a", 5)], "item_id long, text string, score long")
    docs = tricky.withColumnRenamed("length", "score").withColumnRenamed("key", "rank")
    own = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(search.rank(docs, items)) == plain(own, [tuple(r)[:2] for r in items.collect()], 20)


def test_empty_tables(spark, tricky):
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert search.rank(tricky.limit(0), items).collect() == []
    assert search.rank(tricky, items.limit(0)).collect() == []


def test_node_pairs_are_pruned_and_nothing_is_lost():
    rng = np.random.default_rng(3)
    points = np.where(rng.random((50, 400)) < 0.03, rng.integers(1, 9000, (50, 400)), 0).astype(float)
    docs = np.where(rng.random((3000, 400)) < 0.03, rng.integers(1, 900_000, (3000, 400)), 0).astype(float)
    docs[2000] = docs[11]  # a tie
    own = search.Search(points, np.ones(50, dtype=np.int64), 5)
    for start in range(0, 3000, 512):
        own.add(docs[start : start + 512], list(range(start, min(3000, start + 512))))
    got = defaultdict(list)
    for item, doc, score in own.found():
        got[item].append((-score, doc))
    scores = points @ docs.T
    for item in range(50):
        assert sorted(got[item]) == sorted((-int(s), d) for d, s in enumerate(scores[item]) if s > 0)[:5]
    assert own.bounded < 50 * 3000 / 2


def test_scores_beyond_doubles_are_exact():
    block = search.Block([1], [{b"a": 10**6, b"b": 1}], {b"a": 0, b"b": 1})
    points = search.weights(block, {0: 1, 1: 1}, 10**6)
    assert points.dtype == np.int64
    own = search.Search(points, np.ones(1, dtype=np.int64), 2)
    own.add(np.array([[999_999, 0], [999_999, 1]], dtype=np.int64), [1, 2])
    assert sorted(own.found()) == [(0, 1, int(points[0, 0]) * 999_999), (0, 2, int(points[0, 0]) * 999_999 + int(points[0, 1]))]

import random

import numpy as np
import pytest

from feedloom.llm import near_dedup as nd

from .conftest import TRICKY


def brute(rows, percent=80):
    """(doc_id, text) -> {doc_id: (n_shingles, component)} by all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in by[g] if j > i}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def compare(df, rows, percent=80):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == brute(rows, percent)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    df = nd.op7_setsketch_near_dedup(spark, path)
    compare(df, rows, 85)
    assert df.filter("kept <> (doc_id = component_id)").count() == 0


def drifting(n, seed=3):
    """A family whose members drift apart: many links, and many near misses."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(160)]
    family = [base]
    while len(family) < n:
        words = list(rng.choice(family))
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        family.append(words)
    rng.shuffle(family)
    return [(i, " ".join(w)) for i, w in enumerate(family)]


def test_drifting_family_in_blocks(spark, monkeypatch):
    rows = drifting(300)
    compare(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    monkeypatch.setattr(nd, "BLOCK", 16)
    compare(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_tricky_rows(spark, tricky):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(tricky).collect()))
    want = brute([r for r in TRICKY if r[0] is not None])
    assert len(got) == len(TRICKY)
    for null, i, n, c, kept in got:
        assert (n, c) == want[i] if not null else (c is None and kept)
        assert null or kept == (c == i)
    assert nd.near_duplicates(tricky.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l"), (4, "z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nd.near_duplicates(again).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    errors = []
    for j in (0.3, 0.6, 0.85, 0.95):
        for _ in range(10):
            x = rng.integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2)
            common = int(2000 * j)
            a = np.unique(x[: common + (2000 - common) // 2])
            b = np.unique(np.concatenate([x[:common], x[common + (2000 - common) // 2 :]]))
            r = nd.registers_of([a, b])
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(nd.estimate(r[0], r[1], len(a), len(b)) - truth)
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.1


def test_registers_merge_by_maximum():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2))
    r = nd.registers_of([a, b, np.unique(np.concatenate([a, b]))])
    assert (np.maximum(r[0], r[1]) == r[2]).all()

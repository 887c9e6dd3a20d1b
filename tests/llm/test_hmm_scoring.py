import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import hmm_scoring as hmm

from .conftest import SF, TRICKY


def brute(rows):
    """(doc_id, text) -> contract columns but the model's score, in order."""
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"] for _, t in rows]
    held = [zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [
        (i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        for (i, _), ws, h in zip(rows, words, held, strict=True)
    ]


def same(got, rows):
    order = lambda x: (str(x[0]), x[2], round(x[5], 6))
    got, want = sorted((tuple(r) for r in got), key=order), sorted(brute(rows), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and math.isfinite(a[6]) and a[6] < 0


@pytest.mark.parametrize("small", [False, True])
def test_query_against_brute_force(spark, documents, small):
    # with small bounds most words take the join
    got = (hmm.score(documents, looked_up=300, symbols=100) if small else hmm.op9_hmm_scores(spark, SF)).collect()
    same(got, [(r.doc_id, r.text) for r in documents.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tricky_rows(spark, tricky):
    same(hmm.score(tricky).collect(), TRICKY)
    assert hmm.score(tricky.limit(0)).count() == 0
    alone = [(i, t) for i, t in TRICKY if zlib.crc32(str(i).encode()) % 10 == 0] or [(30, "a b c")]
    same(hmm.score(spark.createDataFrame(alone, "doc_id long, text string")).collect(), alone)


def test_forward_and_counts_against_enumeration():
    rng = np.random.default_rng(4)
    norm = lambda x, axis: (x / x.sum(axis=axis, keepdims=True)).astype(np.float32)
    model = hmm.Hmm(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((3, 2)), 0))
    sequences = [np.array(s) for s in ([0], [1, 2], [2, 0, 1, 1], [0, 2, 1])]
    logs, start, step, emit = [], np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for s in sequences:
        paths = {}
        for code in range(2 ** len(s)):
            z = [(code >> k) & 1 for k in range(len(s))]
            p = model.start[z[0]] * model.emit[s[0], z[0]]
            for k in range(1, len(s)):
                p *= model.step[z[k - 1], z[k]] * model.emit[s[k], z[k]]
            paths[tuple(z)] = float(p)
        total = sum(paths.values())
        logs.append(math.log(total))
        for z, p in paths.items():
            start[z[0]] += p / total
            for k, state in enumerate(z):
                emit[s[k], state] += p / total
                if k:
                    step[z[k - 1], state] += p / total
    together = hmm._Together(sequences, model)
    assert together.forward(keep=True) == pytest.approx(logs, rel=1e-5)
    for a, b in zip(together.counts(), (start, step, emit), strict=True):
        assert a == pytest.approx(b, rel=1e-4, abs=1e-5)


def test_rounds_raise_the_likelihood(spark, documents):
    docs = hmm.with_held_out(documents)
    counts = hmm.word_counts(docs)
    vocabulary = hmm.vocabulary_of(counts)
    encoded = hmm.encode(docs, vocabulary).persist()
    unigram = np.concatenate([vocabulary.counts[: vocabulary.n_symbols] + 0.1, vocabulary.class_mass])
    unigram /= unigram.sum()
    sequences = [r for x in encoded.filter("not held_out").collect() for r in hmm.runs(x.symbols)]
    model, before = hmm.first_model(encoded, unigram, rounds=2), -math.inf
    for _ in range(3):
        model = hmm.baum_welch_round(encoded, model, unigram)
        now = hmm._Together(sequences, model).forward(keep=False).sum()
        assert now > before
        before = now


def test_every_round_reads_every_token(spark):
    # more documents than a sample would hold, and one whose end is unlike its start
    rows = [(i, f"w{i % 50} x") for i in range(1, 2_200)] + [(5_000, "left " * 3_000 + "right " * 3_000)]
    docs = hmm.with_held_out(spark.createDataFrame(rows, "doc_id long, text string"))
    vocabulary = hmm.vocabulary_of(hmm.word_counts(docs))
    encoded = hmm.encode(docs, vocabulary).persist()
    unigram = np.concatenate([vocabulary.counts[: vocabulary.n_symbols] + 0.1, vocabulary.class_mass])
    unigram /= unigram.sum()
    whole = [np.frombuffer(x.symbols, "<i4") for x in encoded.filter("not held_out").collect()]
    assert max(map(len, whole)) == 6_001
    model, want = hmm.random_model(unigram), hmm.random_model(unigram)
    for rounds in (1, 2):
        want = hmm.Hmm.from_counts(*hmm.expected_counts(whole, want), unigram)
        got = hmm.first_model(encoded, unigram, rounds=rounds)
        for a, b in ((got.start, want.start), (got.step, want.step), (got.emit, want.emit)):
            assert a == pytest.approx(b, rel=1e-3, abs=1e-6)
    assert not np.allclose(model.emit, want.emit)


def test_long_sequences_wait_for_each_other(monkeypatch):
    monkeypatch.setattr(hmm, "LONG", 3)
    batches = [[np.arange(n) for n in x] for x in ([1, 9, 2], [5], [4, 3], [])]
    got = list(hmm.together(iter(batches), most=12))
    assert [[len(s) for s in x] for x in got] == [[1, 2], [9, 5], [3], [4]]
    assert list(hmm.together(iter([]))) == []

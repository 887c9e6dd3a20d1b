import numpy as np
from pyspark.sql import functions as F

from feedloom.llm import ordinal_quality as oq

from .conftest import TRICKY

PATH = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{PATH}/documents.parquet"), spark.read.parquet(f"{PATH}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = oq.train(docs, labels.filter(half))
    assert model.thresholds[0] < model.thresholds[1]
    rows = oq.score(docs, model).join(labels.filter(~half), "doc_id").select("kept", "expected_grade", oq.grade_of().alias("g")).collect()
    share = lambda g: np.mean([r.kept for r in rows if r.g == g])
    assert share(2) > 0.96 and share(1) < 0.25 and share(0) < 0.05
    grade = lambda g: np.mean([r.expected_grade for r in rows if r.g == g])
    assert grade(0) < grade(1) < grade(2)
    chosen = oq.select_documents(docs, model)
    assert chosen.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert chosen.count() == oq.score(docs, model).filter("kept").count()


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        z = rng.normal()
        words = [1] * (z > 0.3) + [2] * (z > -0.5) + list(rng.integers(10, 200, 5))
        rows.append({"label": int(z > -0.5) + int(z > 0.3), "counts": np.array(words, "<u4").tobytes(), "shape": [0.0] * len(oq.SHAPES)})
    model = oq.fit(rows)
    assert model.weights.get(1, 0) > 0.5 and model.weights.get(2, 0) > 0.5
    assert max(abs(model.weights.get(i, 0)) for i in range(10, 200)) < 0.5


def test_tricky_rows(spark, tricky):
    empty = oq.train(tricky, spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int"))
    rows = oq.score(tricky, empty).collect()
    assert len(rows) == len(TRICKY) and all(r.kept for r in rows)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (8, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    rows = oq.score(tricky, oq.train(tricky, labels)).collect()
    assert len(rows) == len(TRICKY) and all(0 <= r.expected_grade <= 2 for r in rows)
    assert len({(r.score, r.kept) for r in rows if r.doc_id == 1}) == 1
    assert oq.score(tricky.limit(0), empty).count() == 0


def plain_score(text, model):
    """The score of a text, straight from the definition."""
    words = set(text.encode().lower().split())
    total = sum(model.weights.get(b, 0.0) for w in words for b in oq.features_of(w))
    return total + 4.0 * sum(v * x for v, x in zip(model.shape_weights, oq.shapes(text.encode(), text.encode().lower().split(), len(words)), strict=True))


def test_scores_against_the_definition(spark, documents):
    model = oq.train(documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in oq.score(documents, model).collect():
        s = plain_score(texts[r.doc_id], model)
        tails = [1 / (1 + np.exp(t - s)) for t in model.thresholds]
        assert abs(r.score - s) < 1e-9 and abs(r.tail_probability - tails[-1]) < 1e-9 and abs(r.expected_grade - sum(tails)) < 1e-9
        assert r.grade == sum(t >= 0.5 for t in tails) and r.kept == (tails[-1] >= oq.LEAST_TAIL)


def test_fit_reaches_the_optimum():
    """No small step from the fitted model lowers the penalised loss by more than a trifle."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        z = rng.normal()
        words = [1] * (z > 0.2) + [2] * (z > -0.6) + list(rng.integers(10, 30, 4))
        rows.append({"label": int(z + rng.normal() * 0.5 > -0.5) + int(z + rng.normal() * 0.5 > 0.4), "counts": np.array(words, "<u4").tobytes(), "shape": [0.0] * len(oq.SHAPES)})
        rows[-1]["label"] = min(2, rows[-1]["label"])
    penalty = 1e-3
    model = oq.fit(rows, penalty=penalty, rounds=3000)
    ids = sorted({int(i) for r in rows for i in np.frombuffer(r["counts"], "<u4")})
    grades = np.array([r["label"] for r in rows])
    x = np.array([[np.frombuffer(r["counts"], "<u4").tolist().count(i) for i in ids] for r in rows], float)
    balance = np.array([1 / (grades == g).sum() for g in grades])
    balance /= balance.sum()

    def loss(w, t):
        s = x @ w
        p = [np.ones(len(s)), *(1 / (1 + np.exp(k - s)) for k in t), np.zeros(len(s))]
        mass = np.array([p[g][i] - p[g + 1][i] for i, g in enumerate(grades)])
        return -np.sum(balance * np.log(mass)) + penalty * np.abs(w).sum()

    w, t = np.array([model.weights.get(i, 0.0) for i in ids]), np.array(model.thresholds)
    best = loss(w, t)
    for j in range(len(w)):
        for step in (-0.02, 0.02):
            assert loss(w + step * (np.arange(len(w)) == j), t) > best - 2e-4
    for j in range(2):
        for step in (-0.02, 0.02):
            assert loss(w, t + step * (np.arange(2) == j)) > best - 2e-4

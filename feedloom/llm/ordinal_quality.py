"""Quality classifier: ordinal cumulative-link regression (operator 1).

Ratings are graded: 0 junk, 1 fluent but toxic, 2 clean. One weight vector over
hashed words and word beginnings, shared by all grades, gives a document's
score s; ordered thresholds t1 < t2 cut it: P(grade >= k) = 1 / (1 + exp(t_k - s)).
An L1 penalty keeps only words that matter, so long documents do not gather
noise. Selection reads the expected grade and the tail probability P(grade >= 2).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of
from .quality_rules import labelled_sample

#: Hash buckets of the shared weights; prefix features have this many letters.
BUCKETS, PREFIX = 1 << 18, 5
GRADES = 3
#: Labelled documents that the model is fitted on, at most.
MOST_TRAIN = 6_000
#: Documents with less P(grade >= 2) are rejected.
LEAST_TAIL = 0.6
SHAPES = ("upper", "symbols", "shouts", "digits", "distinct", "repeated_lines", "short")
_STRIP = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
_UPPER, _SYMBOLS, _DIGITS = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&|<>", "0123456789"))


def grade_of() -> Column:
    """Graded rating from the labels: junk 0, toxic 1, clean 2; null if unknown."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def shapes(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Shares between 0 and 1 that say how a text looks."""
    n, chars = max(len(words), 1), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / chars
    return [
        min(1.0, 2 * share(_UPPER)), min(1.0, 5 * share(_SYMBOLS)), min(1.0, 10 * share(b"!?")), min(1.0, 5 * share(_DIGITS)),
        distinct / n, 1 - len(set(lines)) / max(len(lines), 1), 1.0 if len(words) < 10 else 0.0,
    ]


def features_of(word: bytes) -> tuple[int, ...]:
    """Hash buckets of a distinct word: itself and its beginning."""
    word = word.strip(_STRIP)
    if not word:
        return ()
    head = word.decode("utf-8", "ignore")[:PREFIX].encode()
    return (zlib.crc32(word) % BUCKETS, zlib.crc32(b"^" + head) % BUCKETS) if len(word) > PREFIX else (zlib.crc32(word) % BUCKETS,)


@dataclass(frozen=True)
class OrdinalModel:
    """Sparse shared weights, shape weights and ordered thresholds."""

    weights: dict[int, float]
    shape_weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to the top grade, one row per score."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - score[:, None], -40, 40)))


class _WordWeights(dict):
    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        value = sum(self.weights.get(b, 0.0) for b in features_of(word))
        if len(word) <= 32:
            if len(self) >= 400_000:
                self.clear()
            self[word] = value
        return value


def training_features(sample: DataFrame) -> DataFrame:
    """``label, counts, shape``: hashed features of each sampled document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashed, looks = [], []
            for text in batch["text"].to_pylist():
                raw = text.encode()
                words = raw.lower().split()
                distinct = set(words)
                found = [b for w in distinct for b in features_of(w)]
                hashed.append(np.array(found, dtype="<u4").tobytes())
                looks.append(shapes(raw, words, len(distinct)))
            yield pa.RecordBatch.from_arrays(
                [batch["label"], pa.array(hashed, pa.binary()), pa.array(looks, pa.list_(pa.float64()))], ["label", "counts", "shape"]
            )

    return sample.select("label", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, "label int, counts binary, shape array<double>")


def fit(rows: list, *, penalty: float = 2e-4, rounds: int = 250, least_rows: int = 3) -> OrdinalModel:
    """Fit by accelerated proximal gradient on ``label, counts, shape`` rows.

    Features of fewer than ``least_rows`` rows are left out. Grades that do not
    occur leave their threshold at its neighbour's; no rows give a model that
    keeps everything.
    """
    if not rows:
        return OrdinalModel({}, (0.0,) * len(SHAPES), (-20.0,) * (GRADES - 1))
    grades = np.array([r["label"] for r in rows])
    n = len(rows)
    found = [np.unique(np.frombuffer(r["counts"], "<u4"), return_counts=True) for r in rows]
    ids, times = np.concatenate([i for i, _ in found]).astype(np.int64), np.concatenate([c for _, c in found])
    owner = np.repeat(np.arange(n), [len(i) for i, _ in found])
    often = np.bincount(ids, minlength=BUCKETS) >= least_rows
    keep = often[ids]
    ids, owner = ids[keep], owner[keep].astype(np.int32)
    known, column = np.unique(ids, return_inverse=True)
    column, values = column.astype(np.int32), times[keep].astype(np.float32)
    del found, ids, times, keep
    looks = np.array([r["shape"] for r in rows]) * 4.0
    d = len(known)
    # thresholds start at the shares of the grades, kept apart
    share = np.clip([(grades >= k).mean() for k in range(1, GRADES)], 1e-3, 1 - 1e-3)
    t = np.maximum.accumulate(-np.log(share / (1 - share))) + 0.01 * np.arange(GRADES - 1)
    balance = np.zeros(n)
    for k in range(GRADES):
        if (grades == k).any():
            balance[grades == k] = 1 / (grades == k).sum()
    balance *= 1 / balance.sum()
    w, v = np.zeros(d), np.zeros(len(SHAPES))
    w_at, v_at, t_at, momentum = w, v, t, 1.0
    # a step that suits each feature's scale: its weighted count of rows
    scale_w = np.bincount(column, weights=balance[owner] * values, minlength=d)
    row_mass = np.bincount(owner, weights=values, minlength=n).mean()
    step_w = 4.0 / (row_mass * np.maximum(scale_w, scale_w[scale_w > 0].min() if d else 1.0) + 1e-9) if d else scale_w
    step_w = np.minimum(step_w, 4.0 / (row_mass * max(np.median(scale_w), 1e-9)) if d else 1.0)
    loss_before = np.inf
    for _ in range(rounds):
        s = np.bincount(owner, weights=values * w_at[column], minlength=n) + looks @ v_at
        p = 1 / (1 + np.exp(np.clip(t_at[None, :] - s[:, None], -40, 40)))  # tails
        up = np.concatenate([np.ones((n, 1)), p], axis=1)
        down = np.concatenate([p, np.zeros((n, 1))], axis=1)
        pick = np.arange(n)
        a, b = up[pick, grades], down[pick, grades]
        mass = np.maximum(a - b, 1e-12)
        loss = -np.sum(balance * np.log(mass)) + penalty * np.abs(w_at).sum()
        da, db = a * (1 - a), b * (1 - b)
        slope_s = -balance * (da - db) / mass
        slope_t = np.zeros(GRADES - 1)
        for k in range(1, GRADES):
            slope_t[k - 1] = np.sum(balance * (np.where(grades == k, da, 0) - np.where(grades == k - 1, db, 0)) / mass)
        raw = w_at - step_w * np.bincount(column, weights=values * slope_s[owner], minlength=d)
        w_new = np.sign(raw) * np.maximum(np.abs(raw) - step_w * penalty, 0)
        v_new = v_at - 0.5 * (looks.T @ slope_s)
        t_new = np.sort(t_at - 0.5 * slope_t)
        if loss > loss_before:
            momentum = 1.0  # restart
        loss_before = loss
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        m = (momentum - 1) / following
        w_at, v_at, t_at = w_new + m * (w_new - w), v_new + m * (v_new - v), np.sort(t_new + m * (t_new - t))
        w, v, t, momentum = w_new, v_new, t_new, following
    weights = {int(known[i]): float(w[i]) for i in np.flatnonzero(w)}
    return OrdinalModel(weights, tuple(float(x) for x in v), tuple(float(x) for x in t))


def train(docs: DataFrame, labels: DataFrame, *, most_train: int = MOST_TRAIN, **options) -> OrdinalModel:
    """Fit on ``most_train`` labelled documents at most, chosen by id hash.

    The hashed features of that bounded sample reach the driver. Null texts count
    as empty; labels without a document, or without both grades, do not count;
    without any label all documents score alike. Other columns are ignored.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), labels, most_train, grade_of())
    return fit(training_features(sample).collect(), **options)


def _scorer(model: OrdinalModel):
    weights, looks = _WordWeights(model.weights), np.array(model.shape_weights) * 4.0

    def scores(texts: list[str | None]) -> np.ndarray:
        out = []
        for text in texts:
            raw = (text or "").encode()
            words = raw.lower().split()
            distinct = set(words)
            out.append(sum(map(weights.__getitem__, distinct)) + float(looks @ np.array(shapes(raw, words, len(distinct)))))
        return np.array(out)

    return scores


def score(docs: DataFrame, model: OrdinalModel, *, least_tail: float = LEAST_TAIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, expected_grade, tail_probability, grade, kept`` per row.

    ``kept``: the tail probability is at least ``least_tail``. Null text counts
    as empty. Repeated rows and null ids each come back; other columns are
    ignored; an empty table gives none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in slices(batches, "text"):
            s = scores(batch["text"].to_pylist())
            tails = model.tails(s)
            grade = (tails >= 0.5).sum(axis=1).astype(np.int32)
            arrays = [batch["doc_id"], *map(pa.array, (s, tails.sum(axis=1), tails[:, -1], grade, tails[:, -1] >= least_tail))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "expected_grade", "tail_probability", "grade", "kept"])

    schema = "doc_id long, score double, expected_grade double, tail_probability double, grade int, kept boolean"
    return texts_of(docs, id_col, text_col).mapInArrow(each, schema)


def select_documents(docs: DataFrame, model: OrdinalModel, *, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns.

    Null text counts as empty. Repeated rows and null ids are judged like any
    other row; an empty table gives none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(model.tails(scores(batch["text"].to_pylist()))[:, -1] >= least_tail))

    own = docs.withColumn("text", F.col("text").cast("string"))
    return own.mapInArrow(each, own.schema)


def op1_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of all documents; edge cases as in ``train`` and ``score``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

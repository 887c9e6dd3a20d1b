"""Language-model scores by a hidden Markov model (operator 9).

Symbols are the most frequent words and, for the others, classes by word ending;
inside its class a word has its smoothed unigram share. Every round of Baum-Welch
runs over the whole token sequences of all training documents: each task adds up
expected counts, which Spark sums by blocks of symbols. The score of a document
is the exact likelihood of its whole token sequence by the scaled forward
recursion. Word counts come from all training documents; frequent words are
looked up in a bounded table, the others by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, most_frequent, slices, texts_of

END = b"\n"
#: Words that are symbols, words looked up without a join, and ending classes; bounds.
SYMBOLS, LOOKED_UP, CLASSES = 32_768, 200_000, 256
STATES = 8
#: Rounds over all training documents. On 3.6 million tokens the held-out score per
#: token is -2.971 after 2 rounds, -2.912 after 8 and -2.901 after 27.
ROUNDS = 8
#: Share of the unigram in each state's emissions.
MIX = 0.1
#: Tokens beyond which a sequence waits for others as long.
LONG = 4_096
#: Symbols whose counts travel in one row.
BLOCK = 1_024
#: Rows of a block that are summed in one group.
FAN_IN = 64
#: Splits of the scan that a task of a round takes, once there are more than the cores need.
TOGETHER = 4
_COUNTED = 400_000


def with_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, held_out``; a null id counts as the empty text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return texts_of(docs, id_col, text_col).withColumn("held_out", F.crc32(name.cast("binary")) % 10 == 0)


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


def ending_class(word: bytes) -> int:
    return zlib.crc32(word.decode()[-2:].encode()) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over all training tokens, pre-aggregated by task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in slices(batches, "text", 1 << 20):
            for text in batch["text"].to_pylist():
                counts.update(tokens(text))
            if len(counts) > _COUNTED:
                yield flush()
        if counts:
            yield flush()

    return docs.filter("not held_out").select("text").mapInArrow(partial, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """The bounded part of the counts, and what normalises the rest."""

    words: pa.Array  # by falling count
    counts: np.ndarray
    class_mass: np.ndarray  # of words that are no symbols: sum of c + 0.1, and 0.1 for an unknown one
    total: int
    distinct: int
    n_symbols: int  # the first of the words, each a symbol of its own


def vocabulary_of(counts: DataFrame, *, symbols: int = SYMBOLS, looked_up: int = LOOKED_UP) -> Vocabulary:
    """Collect the words of the highest counts, ``looked_up`` at most.

    The cut falls between two cells of a histogram of log counts, so words of
    equal count stay together and only bounded tables reach the driver.
    """
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, looked_up).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, c = top["word"].combine_chunks(), top["c"].to_numpy().astype(np.int64)
    ending = F.crc32(F.right("word", F.lit(2)).cast("binary")) % CLASSES
    mass = np.zeros(CLASSES)
    for row in counts.groupBy(ending.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[row["k"]] = row["c"] + 0.1 * row["n"]
    n = min(symbols, len(c))
    for word, count in zip(words[:n].to_pylist(), c[:n], strict=True):
        mass[ending_class(word.encode())] -= count + 0.1
    return Vocabulary(words, c, np.maximum(mass, 0) + 0.1, totals[0], totals[1], n)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Symbols of each document, what is known of its scores, and its rarer words.

    ``symbols`` are little-endian 32-bit; ``base`` and ``inner`` hold the parts
    of the base score and of the shares inside classes that need no join.
    """
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "symbols", "rare"]
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n_symbols = vocabulary, vocabulary.n_symbols
        known = {w.encode(): i for i, w in enumerate(v.words.to_pylist())}
        z = np.log10(v.total + 0.1 * (v.distinct + 1))
        n_words = len(known)
        base_of = np.append(np.log10(v.counts + 0.1) - z, -z)  # the last: the part of a rare word without its count
        classes = np.array([ending_class(w) for w in known], dtype=np.int64)
        symbol_of = np.append(np.arange(n_symbols), n_symbols + classes[n_symbols:]).astype(np.int32)
        inner_of = np.log10(v.counts + 0.1) - np.log10(v.class_mass[classes]) if n_words else np.zeros(0)
        inner_of[:n_symbols] = 0
        log_mass = np.log10(v.class_mass)
        place = known.get
        for batch in slices(batches, "text", 2 << 20):
            out = []
            for text in batch["text"].to_pylist():
                words = tokens(text)
                ids = np.array([place(w, -1) for w in words], dtype=np.int64)
                unknown = np.flatnonzero(ids < 0)
                base, symbols = float(base_of[ids].sum()), np.empty(len(ids), dtype="<i4")
                seen = ids >= 0
                symbols[seen] = symbol_of[ids[seen]]
                inner = float(inner_of[ids[seen]].sum())
                rare: Counter = Counter()
                if len(unknown):
                    its = [words[i] for i in unknown]
                    ends = np.array([ending_class(w) for w in its])
                    symbols[unknown] = n_symbols + ends
                    inner -= float(log_mass[ends].sum())
                    rare.update(its)
                out.append((len(ids), int(seen.sum()), base, inner, symbols.tobytes(), [{"word": w.decode(), "n": n} for w, n in rare.items()]))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rare_type]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True))], names
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, symbols binary, rare array<struct<word:string,n:long>>"
    return docs.mapInArrow(each, schema)


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @staticmethod
    def from_counts(start, step, emit, unigram) -> Hmm:
        """The maximum of the expected counts, mixed with the unigram shares.

        A symbol without any count (a class of unknown words only) keeps its
        unigram share in every state.
        """
        emission = (1 - MIX) * emit / np.maximum(emit.sum(axis=0), 1e-9) + MIX * unigram[:, None]
        emission = np.where(emit.sum(axis=1, keepdims=True) < 0.5, unigram[:, None], emission)
        emission = emission / emission.sum(axis=0)
        step, start = step + 0.5, start + 0.5
        return Hmm((start / start.sum()).astype(np.float32), (step / step.sum(axis=1, keepdims=True)).astype(np.float32), emission.astype(np.float32))


class _Together:
    """Sequences of one batch side by side: step t of all of them in one go."""

    def __init__(self, sequences: list[np.ndarray], model: Hmm):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        self.starts = np.concatenate([[0], np.cumsum(self.active)])
        total = int(lengths.sum())
        at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.symbols = np.empty(total, dtype=np.int64)
        self.symbols[self.starts[at] + np.repeat(np.arange(len(lengths)), lengths)] = np.concatenate([sequences[i] for i in self.order])
        self.model, self.emitted, self.n = model, model.emit[self.symbols], len(lengths)

    def forward(self, keep: bool) -> np.ndarray:
        """Log-likelihoods in the given order; ``keep`` stores what counts need."""
        model, logs = self.model, np.zeros(self.n)
        if keep:
            self.alpha, self.scale = np.empty_like(self.emitted), np.empty(len(self.symbols), dtype=np.float32)
        a, ones = None, np.ones(len(model.start), dtype=np.float32)
        for t, n in enumerate(self.active):
            here = slice(self.starts[t], self.starts[t + 1])
            a = (model.start if t == 0 else a[:n] @ model.step) * self.emitted[here]
            c = a @ ones  # faster than a sum over a short axis
            a /= c[:, None]
            logs[:n] += np.log(c)
            if keep:
                self.alpha[here], self.scale[here] = a, c
        out = np.empty(self.n)
        out[self.order] = logs
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, steps and emissions; once, after ``forward(keep=True)``."""
        states, step = len(self.model.start), np.zeros((len(self.model.start),) * 2)
        gamma = self.alpha  # overwritten from the end
        after, n_after = None, 0
        for t in range(len(self.active) - 1, -1, -1):
            here, n = slice(self.starts[t], self.starts[t + 1]), self.active[t]
            beta = np.ones((n, states), dtype=np.float32)
            if n_after:
                beta[:n_after] = after @ self.model.step.T
                step += self.alpha[here][:n_after].T @ after
            gamma[here] *= beta
            after, n_after = self.emitted[here] * beta / self.scale[here][:, None], n
        emit = np.stack([np.bincount(self.symbols, weights=gamma[:, s], minlength=len(self.model.emit)) for s in range(states)], axis=1)
        return gamma[: self.n].sum(axis=0), step * self.model.step, emit


def expected_counts(sequences: list[np.ndarray], model: Hmm):
    together = _Together(sequences, model)
    together.forward(keep=True)
    return together.counts()


def runs(symbols: bytes) -> list[np.ndarray]:
    """The training sequences of a document: one, of all its tokens."""
    return [np.frombuffer(symbols, "<i4")]


def together(batches: Iterator[list[np.ndarray]], most: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """The same sequences, long ones kept back until ``most`` tokens of them wait.

    Sequences of a batch go side by side, step by step, so a batch takes as many
    steps as its longest one has: long ones are best among their like.
    """
    long, waiting = [], 0
    for batch in batches:
        short = [s for s in batch if len(s) <= LONG]
        if short:
            yield short
        for s in batch:
            if len(s) > LONG:
                long.append(s)
                waiting += len(s)
                if waiting >= most:
                    yield long
                    long, waiting = [], 0
    if long:
        yield long


def _sum_rows(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table["data"].to_pylist())
    return pa.table({"block": table["block"][:1], "part": table["part"][:1], "data": pa.array([total.tobytes()], pa.binary())})


def baum_welch_round(encoded: DataFrame, model: Hmm, unigram: np.ndarray) -> Hmm:
    """One round over all training rows of ``encoded``.

    A task takes up to ``TOGETHER`` splits of the scan, so tasks grow in number
    with the input, and long sequences find their like in a task. A task emits one
    row for each block of symbols that it saw, and the rows of a block are summed
    ``FAN_IN`` at a time, level by level, so that no group grows.
    """
    states, n_symbols = len(model.start), len(model.emit)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((n_symbols, states))
        lists = ([r for x in batch["symbols"].to_pylist() for r in runs(x)] for batch in slices(batches, "symbols", 4 << 20))
        for sequences in together(lists):
            for total, part in zip((start, step, emit), expected_counts(sequences, model), strict=True):
                total += part
        cut = ((b, emit[b * BLOCK : (b + 1) * BLOCK].ravel()) for b in range(-(-n_symbols // BLOCK)))
        rows = [(-1, np.concatenate([start, step.ravel()])), *((b, x) for b, x in cut if x.any())]
        part = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([x.tobytes() for _, x in rows], pa.binary())],
            ["block", "part", "data"],
        )

    rows = encoded.filter("not held_out").select("symbols")
    tasks = max(2 * encoded.sparkSession.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // TOGETHER))
    summed, groups = rows.coalesce(tasks).mapInArrow(partial, "block int, part int, data binary"), -(-tasks // FAN_IN)
    while groups > 1:
        summed = summed.groupBy("block", "part").applyInArrow(_sum_rows, "block int, part int, data binary").withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        groups = -(-groups // FAN_IN)
    summed = summed.groupBy("block").applyInArrow(_sum_rows, "block int, part int, data binary")
    data = {r["block"]: np.frombuffer(r["data"], np.float64) for r in summed.collect()}
    if -1 not in data:
        return model
    head, emit = data.pop(-1), np.zeros((n_symbols, states))
    for block, counts in data.items():
        emit[block * BLOCK : (block + 1) * BLOCK] = counts.reshape(-1, states)
    return Hmm.from_counts(head[:states], head[states:].reshape(states, states), emit, unigram)


def random_model(unigram: np.ndarray, states: int = STATES, seed: int = 11) -> Hmm:
    """States that are likely to stay, each with emissions near the unigram."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * np.exp(rng.normal(0, 0.5, (len(unigram), states)))
    step = np.full((states, states), 0.1 / max(states - 1, 1)) + (0.9 - 0.1 / max(states - 1, 1)) * np.eye(states)
    return Hmm(np.full(states, 1 / states, dtype=np.float32), (step / step.sum(axis=1, keepdims=True)).astype(np.float32), (emit / emit.sum(axis=0)).astype(np.float32))


def first_model(encoded: DataFrame, unigram: np.ndarray, *, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """``rounds`` of Baum-Welch from a random start, each over all training rows."""
    model = random_model(unigram, states)
    for _ in range(rounds):
        model = baum_welch_round(encoded, model, unigram)
    return model


def train(encoded: DataFrame, vocabulary: Vocabulary, *, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """The model after ``rounds`` rounds over all training documents."""
    unigram = np.concatenate([vocabulary.counts[: vocabulary.n_symbols] + 0.1, vocabulary.class_mass])
    return first_model(encoded, unigram / unigram.sum(), states=states, rounds=rounds)


def score(docs: DataFrame, *, states: int = STATES, rounds: int = ROUNDS, symbols: int = SYMBOLS, looked_up: int = LOOKED_UP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on what is not held out, and score every row's whole text.

    Null text counts as empty: the end token alone. Repeated rows and null ids
    each come back; other columns are ignored; an empty table gives none. With
    no training rows, every word is unknown.
    """
    counts = materialize(word_counts(with_held_out(docs, id_col, text_col)), "lm-counts")
    vocabulary = vocabulary_of(counts, symbols=symbols, looked_up=looked_up)
    encoded = encode(with_held_out(docs, id_col, text_col), vocabulary).withColumn("row", F.monotonically_increasing_id())
    encoded = materialize(encoded, "lm-encoded")
    model = train(encoded, vocabulary, states=states, rounds=rounds)
    rare = encoded.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("log_counts"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
    )

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "symbols", 4 << 20):
            logs = _Together([np.frombuffer(x, "<i4") for x in batch["symbols"].to_pylist()], model).forward(keep=False)
            yield batch.drop_columns(["symbols"]).append_column("logs", pa.array(logs / np.log(10)))

    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, row long"
    scored = encoded.select("doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "row", "symbols").mapInArrow(likelihoods, columns + ", logs double")
    extra = F.coalesce("log_counts", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("logs") + F.col("inner") + extra).alias("score"),
    )


def op9_hmm_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; edge cases as in ``score``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Spelling variants by permuterm rotations.

A word with a terminator has one rotation for each place in it. The rotation that
starts behind a place ends with the letter before it: without that letter, two
words that differ in this letter alone share the whole of what is left, and a
word that lacks the letter has exactly this as a rotation of its own. So sorting
the rotations, each under its prefix without the edited letter, brings all words
one edit apart together; a scan of the equal prefixes gives the neighbours. Such a
group has one word for each letter at most, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Letters of a word at least, occurrences at least, and how much more frequent a form is.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many runs loses a letter.
DAMAGED = 31
#: Letters of a prefix that is sorted as it is; longer ones go by a hash of 127 bits,
#: since the rotations of a word together are as long as its square.
LONGEST = 64
#: Distinct words that a task counts at a time, and rows of a batch.
COUNTED, BATCH = 300_000, 20_000
END = "$"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PRIME, _BASE = (1 << 127) - 1, 0x3C6EF372FE94F82A1F83D9ABFB41BD6B
_ROTATION = "key string, letter string, n long, ref string"
_NEIGHBOUR = "ref string, near long, other_n long, other string"


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: runs of letters of whole texts, some of them damaged by a rule on their hash.

    A null id writes nothing before the colon.
    """
    runs = re.compile(rf"[A-Za-zÀ-ÿ]{{{letters},}}")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in slices(batches, "text", 1 << 20):
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                mark = f"{'' if doc_id is None else doc_id}:".encode()
                for run, c in Counter(runs.findall(text.translate(_LOWER).decode())).items() if text else ():
                    h = zlib.crc32(mark + run.encode())
                    if h % DAMAGED == 0:
                        cut = h % len(run)
                        run = run[:cut] + run[cut + 1 :]
                        if len(run) < letters:
                            continue
                    counts[run] += c
            if len(counts) > COUNTED:
                yield flush()
        if counts:
            yield flush()

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return plain.mapInArrow(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """``key, letter, n, ref``: every rotation whole, and without its last letter.

    ``ref`` names the word where ``key`` is a hash; else it follows from the two.
    """
    size = F.char_length("word")
    turned = words.filter(size <= LONGEST).select("word", "n", size.alias("size"), F.explode(F.sequence(F.lit(0), size)).alias("i"))
    behind, before = F.expr("substring(word, i + 1)"), lambda less: F.expr(f"left(word, i - {less})")
    whole = F.struct(F.concat(behind, F.lit(END), before(0)).alias("key"), F.lit("").alias("letter"))
    skipped = F.struct(F.concat(behind, F.lit(END), before(1)).alias("key"), F.expr("substring(word, i, 1)").alias("letter"))
    both = F.array_compact(F.array(F.when(F.col("size") < LONGEST, whole), F.when(F.col("i") > 0, skipped)))
    short = turned.select("n", F.explode(both).alias("r")).select("r.key", "r.letter", "n", F.lit(None).cast("string").alias("ref"))
    return short.unionByName(words.filter(size >= LONGEST).mapInArrow(_hashed_rotations, _ROTATION))


def word_ref(word: str) -> str:
    """The name of a long word while its rotations are hashes; no word begins so."""
    return "#" + hashlib.sha256(word.encode()).hexdigest()


def _hashed_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``rotations``, of long words: both parts of a key as rolling hashes, in steady memory."""
    inverse = pow(_BASE, -1, _PRIME)
    rows: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], ["key", "letter", "n", "ref"])

    for batch in batches:
        for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
            size, ref = len(word), word_ref(word)
            after = 0
            for c in word:
                after = (after * _BASE + ord(c)) % _PRIME
            before, power = 0, pow(_BASE, size - 1, _PRIME)
            for i in range(size + 1):
                rows.append((f"{i} {before:x} {size - i} {after:x}", "", n, ref))
                if i < size:
                    code = ord(word[i])
                    after = (after - code * power) % _PRIME
                    power = power * inverse % _PRIME
                    if size > LONGEST:
                        rows.append((f"{i} {before:x} {size - i - 1} {after:x}", word[i] if i == 0 or word[i - 1] != word[i] else word[i] + "=", n, ref))
                    before = (before * _BASE + code) % _PRIME
                if len(rows) >= BATCH:
                    yield batch_of()
    if rows:
        yield batch_of()


def neighbours(turned: DataFrame) -> DataFrame:
    """``ref, near, other_n, other``: for each word of a group, the best others of it and how many are near.

    ``near`` sums up to the number of near words over all groups: a pair that
    comes by several equal letters in a row counts at the first of them.
    """
    return turned.repartition("key").sortWithinPartitions("key", "letter").mapInArrow(_scan, _NEIGHBOUR)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["ref", "near", "other_n", "other"])

    group: list[tuple] = []
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        keys = batch["key"]
        starts = [i + 1 for i in pc.indices_nonzero(pc.not_equal(keys.slice(1), keys.slice(0, rows - 1))).to_pylist()]
        if group and keys[0].as_py() == group[0][0]:
            group += _rows(batch, 0, starts[0] if starts else rows)
        else:
            starts.insert(0, 0)
        if starts and len(group) > 1:
            _group(group, out)
        # The last group may go on in the next batch; of the others, single rows need no look.
        for start, end in zip(starts, starts[1:] + [rows]):
            if end == rows:
                group = _rows(batch, start, end)
            elif end - start > 1:
                _group(_rows(batch, start, end), out)
        if len(out) >= BATCH:
            yield batch_of()
    if len(group) > 1:
        _group(group, out)
    yield batch_of()


def _rows(batch: pa.RecordBatch, start: int, end: int) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in batch.slice(start, end - start).columns)))


def _group(rows: list[tuple], out: list[tuple]) -> None:
    """The words of one key: at most one that lacks the letter, all others in the order of the letter."""
    words = []
    for key, letter, n, ref in rows:
        # Behind an equal letter, lacking it is the same word as lacking the one before.
        again = letter.endswith("=") if ref else letter == key[-1]
        if not ref:
            behind, _, before = key.partition(END)
            ref = before + letter + behind
        words.append((-n, letter, again, ref))
    lacking = next((w for w in words if not w[1]), None)
    own = sorted(w for w in words if w[1])
    for word in own:
        if len(own) > 1:
            best = own[1] if word is own[0] else own[0]
            out.append((word[3], len(own) - 1, -best[0], best[3]))
        if lacking:
            out.append((word[3], 0 if word[2] else 1, -lacking[0], lacking[3]))
    if lacking and own:
        out.append((lacking[3], sum(not w[2] for w in own), -own[0][0], own[0][3]))


def variants(docs: DataFrame, *, times: int = TIMES, **options) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word; options as for ``word_counts``.

    ``form`` is the near word of largest ``n``, ties by code points, if it has
    ``times`` (2 or more) the word's; ``root`` is the last of the forms that follow each other.
    Null and empty texts have no words; repeated rows count by themselves; other
    columns are ignored; an empty table gives none. Long texts are read whole, and
    words may have any length.
    """
    words = materialize(word_counts(docs, **options), "variant-words")
    # A word has some twenty rotations: few bytes of words are much work, dealt evenly by number.
    dealt = words.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = materialize(neighbours(rotations(dealt)), "variant-neighbours")
    long = words.filter(F.char_length("word") >= LONGEST).select(F.concat(F.lit("#"), F.sha2("word", 256)).alias("ref"), "word")
    hashed = F.col("ref").startswith("#") | F.col("other").startswith("#")
    named = near.filter(hashed)
    for column in ("ref", "other"):
        names = long.select(F.col("ref").alias(column), F.col("word").alias("_word"))
        named = named.join(names, column, "left").withColumn(column, F.coalesce("_word", column)).drop("_word")
    named = near.filter(~hashed).unionByName(named)
    best = named.groupBy(F.col("ref").alias("word")).agg(F.sum("near").alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("best"))
    other_n = -F.col("best")["col1"]
    enough = other_n >= times * F.col("n")
    joined = words.join(best, "word", "left").select(
        "word", F.when(enough, F.col("best")["other"]).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, other_n).alias("form_n")
    )
    found = materialize(joined, "variant-forms")
    return found.join(roots(found, times), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(found: DataFrame, times: int) -> DataFrame:
    """``word, root`` of words with a form, by doubling the distance each round.

    Counts grow ``times`` with each form, which bounds how many follow each other.
    """
    steps = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = found.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    reach = 1
    while times ** (reach + 1) <= most:
        reach *= 2
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        steps = materialize(steps.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "variant-roots")
    return steps


def op13_permuterm_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants in all documents; edge cases as in ``variants``."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))

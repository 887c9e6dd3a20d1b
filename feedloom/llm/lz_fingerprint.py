"""Document fingerprints from Lempel-Ziv phrases (operator 4).

A text is parsed from left to right into phrases: each is the longest phrase
already known plus one code point, and joins the dictionary. The fingerprint is
the minimum-hash signature of the phrase set, its ``SIZE`` smallest hashes. Two
texts that compress well together share many phrases; the likeness of two
signatures estimates the Jaccard similarity of the phrase sets, and is exact
while the two sets together hold at most ``SIZE`` phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

#: Hashes in a signature; each is 32 bits, written as eight hex digits.
SIZE = 128
_MULTIPLIER, _MASK = 0x5851F42D4C957F2D, (1 << 60) - 1
_LOWEST = -(1 << 63)


class PhraseParser:
    """The incremental parse of one text, which can go back to a mark."""

    def __init__(self) -> None:
        self.trie: dict[int, int] = {}
        self.hashes: list[int] = [0x9E3779B97F4A7C1]  # by phrase; 0 is the empty phrase
        self.added: list[int] = []
        self.node = 0

    def feed(self, text: str) -> None:
        trie, hashes, added, node = self.trie, self.hashes, self.added, self.node
        known = trie.get
        for code in np.frombuffer(text.encode("utf-32-le"), dtype="<u4").tolist():
            key = node | code
            step = known(key)
            if step is None:
                trie[key] = len(hashes) << 21
                hashes.append((hashes[node >> 21] * _MULTIPLIER + code + 1) & _MASK)
                added.append(key)
                node = 0
            else:
                node = step
        self.node = node

    def mark(self) -> tuple[int, int]:
        return len(self.added), self.node

    def back_to(self, mark: tuple[int, int]) -> None:
        n, self.node = mark
        for key in self.added[n:]:
            del self.trie[key]
        del self.added[n:], self.hashes[n + 1 :]

    def signature(self) -> np.ndarray:
        """Sorted, distinct 32-bit hashes, ``SIZE`` at most."""
        x = np.array(self.hashes[1:], dtype=np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = np.unique((x ^ (x >> np.uint64(31))) >> np.uint64(32)) if len(x) <= 4 * SIZE else _smallest(x ^ (x >> np.uint64(31)))
        return x[:SIZE].astype(np.uint32)


def _smallest(x: np.ndarray) -> np.ndarray:
    # twice as many as needed, so that equal 32-bit values cannot shorten the signature
    return np.unique(np.partition(x, 2 * SIZE)[: 2 * SIZE] >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two signatures; 1.0 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIZE]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprint_text(text: str) -> str:
    """The fingerprint of one text; the empty string for the empty text."""
    parser = PhraseParser()
    parser.feed(text)
    return to_text(parser.signature())


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` for every row, in one pass without a shuffle.

    Null text counts as empty, with an empty fingerprint. Equal texts have equal
    fingerprints. Repeated rows and null ids come back as they are; other
    columns are ignored; an empty table gives none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = [fingerprint_text(x) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return texts_of(docs, id_col, text_col).mapInArrow(each, "doc_id long, fingerprint string")


def with_next_document(docs: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """Range-partition documents so that each meets its next one in its task.

    Next means by descending ``doc_id``; the last is followed by the first. Rows
    are cut into ``ranges`` of ids of about equal count; each range also gets
    the first row of the following range, marked ``borrowed``, so that no task
    holds more than its range and only one id per range reaches the driver.
    Equal ids follow by the hash of their text; null ids come last. An empty table
    gives none.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 8 * partitions
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("rank", F.col("key").cast("double"))
    inner = sorted({0.0, *keyed.select("rank").approxQuantile("rank", [i / ranges for i in range(1, ranges)], 0.25 / ranges)})
    splits = [float("-inf"), *inner, float("inf")]
    keyed = Bucketizer(splits=splits, inputCol="rank", outputCol="range").transform(keyed)
    firsts = sorted(keyed.select("range", "key").groupBy("range").agg(F.max("key")).collect(), reverse=True)
    heads = [(firsts[(i + 1) % len(firsts)][1], firsts[i][0]) for i in range(len(firsts))]
    lent = F.broadcast(spark.createDataFrame(heads, "key long, lent_to double"))  # one row per range
    return (
        keyed.join(lent, "key", "left")
        .select("doc_id", "key", "text", F.posexplode(F.array_compact(F.array("range", "lent_to"))).alias("borrowed", "range"))
        .repartition(partitions, "range")
        .sortWithinPartitions("range", "borrowed", F.desc("key"), F.xxhash64("text"))
        .select("doc_id", "text", "borrowed", "range")
    )


def edited_likeness(docs: DataFrame, *, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, its edited text, and compare with the next one.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by
    the first as many (or all) of the next document's. The common prefix is
    parsed once. A lone document is its own next one. Null text counts as
    empty; repeated rows each come back; other columns are ignored; an empty
    table gives none.
    """
    fields = [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the row before, parsed, and waiting for the text that follows it
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text, borrowed, own in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "borrowed", "range")), strict=True):
                if borrowed and (waiting is None or waiting[0] != own):
                    continue  # an equal id of the borrowed row; the first one has served
                cut = len(text) - len(text) // 3
                parser = PhraseParser()
                parser.feed(text[:cut])
                mark = parser.mark()
                parser.feed(text[cut:])
                signature = parser.signature()
                if waiting is not None:
                    _, its_id, its_text, its_cut, its_parser, its_mark, its_signature = waiting
                    tail = text[: len(its_text) - its_cut]
                    its_parser.back_to(its_mark)
                    its_parser.feed(tail)
                    edited = its_parser.signature()
                    rows.append((
                        its_id, len(its_text), hashlib.sha256((its_text[:its_cut] + tail).encode()).hexdigest(), to_text(its_signature),
                        to_text(edited), likeness(its_signature, edited), likeness(its_signature, signature),
                    ))
                waiting = None if borrowed else (own, doc_id, text, cut, parser, mark, signature)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    return with_next_document(texts_of(docs, id_col, text_col), ranges=ranges).mapInArrow(
        compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op4_lz_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of all documents and of their edited texts; edge cases as in ``edited_likeness``."""
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))

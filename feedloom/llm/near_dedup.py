"""Near-duplicate components by SetSketch registers (operator 7).

A document's set is its distinct five-word shingles. Each set gets a sketch of
truncated minima: register i holds ``floor(1 - log_b(h_i))`` of the least
exponential hash ``h_i`` in the set, so registers merge by maximum and agree for
similar sets. Documents whose registers agree in a whole band share a bucket.

Copies are collapsed first. In each bucket every document is paired with the
smallest id; the joint likelihood of both sketches, given the set sizes, drops
unlikely pairs, and full sets confirm the others. Buckets that the links leave in
several components are then compared in blocks of bounded size, where only links
that join two components come out. So a bucket of any size yields no more rows
than it has members, and no pair that shares a bucket goes unexamined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices, texts_of

SHINGLE = 5
REGISTERS = 256
#: Ratio of successive register cells, and the register of a hash of one.
BASE, ZERO = 1.01, 400
#: Links need 100 * intersection >= PERCENT * union; registers in a band. With
#: more similarity asked for, bands may be longer: 8 registers at 85 per cent.
PERCENT, ROWS = 80, 6
#: Members of a block; larger buckets are compared block against block.
BLOCK = 512

_SEEDS = np.random.RandomState(20_240_607)
_FACTORS = (_SEEDS.randint(0, 2**31, REGISTERS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _SEEDS.randint(0, 2**31, REGISTERS).astype(np.uint32) * np.uint32(2)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 400_000:
                self.clear()
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``text``."""
    words = text.encode().lower().split()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h)
    if n == 0:
        return h
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            acc = np.full(1, n, dtype=np.uint64)
            for x in h:
                acc = acc * _STEP + x
        else:
            acc = h[: n - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                acc = acc * _STEP + h[k : n - SHINGLE + 1 + k]
        return np.unique(_mixed(acc))


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row of ``REGISTERS`` for each non-empty set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((REGISTERS, len(sets)), dtype=np.uint32)
    v = np.empty_like(x)
    for i in range(REGISTERS):
        np.multiply(x, _FACTORS[i], out=v)
        np.add(v, _SHIFTS[i], out=v)
        least[i] = np.minimum.reduceat(v, starts)
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + ZERO, 0, 65_535).astype("<u2")


def _chances(sizes_a, sizes_b, j):
    u = sizes_a / (sizes_a + sizes_b)
    v, c, log_b = 1 - u, (BASE - 1) / BASE, np.log(BASE)
    up, down = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
    p_up, p_down = -np.log1p(-up * c) / log_b, -np.log1p(-down * c) / log_b
    return u, v, p_up, p_down, c / ((1 - up * c) * log_b), c / ((1 - down * c) * log_b)


def likelihood_slope(above, below, equal, sizes_a, sizes_b, j):
    """Slope in ``j`` of the joint log-likelihood of two sketches.

    ``above``, ``below`` and ``equal`` count registers of the first sketch against
    the second. The likelihood is concave: it peaks at ``j`` or beyond where the
    slope is not negative.
    """
    u, v, p_up, p_down, d_up, d_down = _chances(sizes_a, sizes_b, j)
    same = np.maximum(1 - p_up - p_down, 1e-12)
    return equal * (v * d_up + u * d_down) / same - above * v * d_up / p_up - below * u * d_down / p_down


def estimate(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> float:
    """Maximum-likelihood Jaccard similarity of two sketches, by bisection."""
    counts = [float(np.sum(x)) for x in (a > b, a < b, a == b)]
    low, high = 0.0, min(size_a, size_b) / max(size_a, size_b)
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if likelihood_slope(*counts, size_a, size_b, mid) >= 0 else (low, mid)
    return (low + high) / 2


def least_estimate(percent: int) -> float:
    """Pairs whose likelihood peaks below are dropped: four deviations under a link."""
    j = percent / 100
    return j - 4 * (j * (1 - j) / REGISTERS) ** 0.5


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two full sets link; exact in integers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketches(docs: DataFrame, *, full: bool = False) -> DataFrame:
    """``doc_id, n_shingles, sig, registers`` and, if ``full``, ``hashes``.

    ``sig`` is a 128-bit hash of the set; it and ``registers`` are null for an
    empty set. ``hashes`` holds the sorted set, 8 bytes a shingle.
    """
    schema = "doc_id long, n_shingles long, sig string, registers binary" + ", hashes binary" * full

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in slices(batches, "text", 1 << 20):
            sets = [shingle_set(t, known) for t in batch["text"].to_pylist()]
            some = [s for s in sets if len(s)]
            rows = iter(registers_of(some)) if some else iter(())
            columns = [
                batch["doc_id"],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
            ]
            if full:
                columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(each, schema)


def band_keys(registers: Column, rows: int) -> Column:
    """One row per band: ``band`` and the hash of its ``rows`` registers, ``key``."""
    return F.posexplode(F.array(*(F.xxhash64(F.lit(k), F.substring(registers, 2 * rows * k + 1, 2 * rows)) for k in range(REGISTERS // rows))))


def _likely_pairs(percent: int):
    least = least_estimate(percent)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "registers_a", 4 << 20):
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("registers_a", "registers_b"))
            sizes = [batch[c].to_numpy().astype(float) for c in ("n_a", "n_b")]
            counts = [np.sum(x, axis=1).astype(float) for x in (a > b, a < b, a == b)]
            likely = likelihood_slope(*counts, *sizes, least) >= 0
            likely &= 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
            yield batch.select(["a", "b"]).filter(pa.array(likely))

    return each


def _confirmed_pairs(percent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "hashes_a", 4 << 20):
            sets = zip(*(map(lambda x: np.frombuffer(x, np.uint64), batch[c].to_pylist()) for c in ("hashes_a", "hashes_b")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([linked(x, y, percent) for x, y in sets], pa.bool_()))

    return each


def _block_links(percent: int, rows: int):
    """Links between components among the rows of one block pair, exact."""
    least, bands = least_estimate(percent), REGISTERS // rows

    def each(table: pa.Table) -> pa.Table:
        ids, sides, labels = (table[c].to_pylist() for c in ("doc_id", "side", "label"))
        band, crossing = table["band"][0].as_py(), len(set(sides)) > 1
        registers = np.frombuffer(b"".join(table["registers"].to_pylist()), "<u2").reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        sizes, side = np.array([len(s) for s in sets], dtype=float), np.array(sides)
        parent = {x: x for x in labels}

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for i in range(len(ids) - 1):
            r, rest = registers[i], registers[i + 1 :]
            equal = rest == r
            in_band = equal[:, : bands * rows].reshape(len(rest), bands, rows).all(axis=2)
            first = in_band.argmax(axis=1)  # a pair counts in its first common band
            above = (r > rest).sum(axis=1).astype(float)
            same = equal.sum(axis=1).astype(float)
            n, own = sizes[i + 1 :], sizes[i]
            likely = (first == band) & (100 * np.minimum(n, own) >= percent * np.maximum(n, own))
            likely &= likelihood_slope(above, REGISTERS - above - same, same, own, n, least) >= 0
            if crossing:
                likely &= side[i + 1 :] != side[i]
            for j in np.flatnonzero(likely) + i + 1:
                x, y = top(labels[i]), top(labels[j])
                if x != y and linked(sets[i], sets[j], percent):
                    parent[max(x, y)] = min(x, y)
                    links.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return each


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest id of each linked node's component.

    Alternates large and small stars until nothing changes; each round is two
    grouped minima and joins, written to the shared folder. Nodes without a link
    are absent. ``links`` has columns ``a`` and ``b``, without nulls; repeated
    links and those of a node with itself change nothing; an empty table gives none.
    """

    def round_of(edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        return small.select("e.u", "e.v").filter("u > v").distinct()

    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = materialize(edges, "component-edges")
    before = state(edges)
    while True:
        former, edges = edges, materialize(round_of(edges), "component-edges")
        after = state(edges)
        discard(former)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    ``percent``: the Jaccard similarity of a link; ``rows``: registers in a band.

    Null, empty and blank texts have no set and link with nothing. Rows that
    repeat an id share its component, and both are kept or both not. A null id
    takes no part: its component is null and it is kept. Other columns are
    ignored; an empty table gives none.
    """
    texts = texts_of(docs, id_col, text_col)
    base = materialize(sketches(texts), "near-sketches")
    named = base.filter(F.col("doc_id").isNotNull() & F.col("sig").isNotNull())
    # written, so that both sides of the joins below are plain shuffles, which
    # adaptive execution splits where one set has very many copies
    copies = materialize(named.groupBy("sig").agg(F.min("doc_id").alias("rep")), "near-copies")
    alone = base.filter(F.col("doc_id").isNull() | F.col("sig").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("rep"))
    members = named.select("doc_id", "n_shingles", "sig").join(copies, "sig").select("doc_id", "n_shingles", "rep").union(alone)
    firsts = named.join(copies, ["sig"]).filter(F.col("doc_id") == F.col("rep")).select("doc_id", "registers")
    banded = materialize(firsts.select("doc_id", band_keys(F.col("registers"), rows).alias("band", "key")), "near-bands")
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("pivot < last")
    shared = materialize(banded.join(buckets.select("key", "pivot", "n"), "key"), "near-buckets")
    involved = shared.select("doc_id").distinct()
    # a merge join at every size: the ids have no bound that would allow a broadcast
    full = materialize(sketches(texts.join(involved.hint("merge"), "doc_id", "left_semi"), full=True), "near-sets")

    # an id that repeats with another text is one document: its sets link whatever links with any of them
    repeats = members.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    ids = repeats.select(F.col("low").alias("a"), F.col("high").alias("b")).union(members.join(repeats.select("doc_id", "low"), "doc_id").select("rep", "low"))

    pairs = shared.filter("doc_id > pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    side = lambda c, name: full.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col(c).alias(f"{c}_{name}"))
    likely = pairs.join(side("registers", "a"), "a").join(side("registers", "b"), "b").mapInArrow(_likely_pairs(percent), "a long, b long")
    links = likely.join(side("hashes", "a").drop("n_a"), "a").join(side("hashes", "b").drop("n_b"), "b").mapInArrow(_confirmed_pairs(percent), "a long, b long")
    links = materialize(links.union(ids.select("a", "b")), "near-links")
    labels = components(links)

    open_rows = shared.filter("n > 2").join(labels, F.col("doc_id") == F.col("node"), "left").select("key", "band", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
    mixed = open_rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.hash("doc_id"), blocks)
    placed = (
        open_rows.join(mixed, "key")
        .select("key", "band", "doc_id", "label", own.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .join(full.select("doc_id", "registers", "hashes"), "doc_id")
        .select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "band", "doc_id", "label", "side", "registers", "hashes")
    )
    more = placed.groupBy("key", "i", "j").applyInArrow(_block_links(percent, rows), "a long, b long")
    more = materialize(more, "near-links")
    if more.head(1):
        labels = components(links.union(more))
    return (
        members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("label", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    Texts without words and null ids stay; rows that repeat an id stay or go
    together; an empty table gives none.
    """
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__kept_id")).distinct()
    joined = docs.filter("doc_id is not null").join(kept, F.col("doc_id").cast("long") == F.col("__kept_id"), "left_semi")
    return joined.union(docs.filter("doc_id is null"))


def op7_setsketch_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 85 per cent; edge cases as in ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85, rows=8)

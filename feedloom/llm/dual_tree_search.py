"""Ranked lexical search by two trees, one over items and one over documents.

Every node of either tree holds the coordinate maxima of what lies below it. The
product of an item node and a document node bounds every score between them, so
a pair of nodes whose bound is under the weakest k-th score of its items is left
as a whole. What is left cannot enter a result: the ranking is exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices

#: Terms are runs of ASCII letters, digits and all code points from U+0080; in
#: UTF-8 the bytes of the latter are 0x80 and above. A-Z become a-z.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Items times distinct terms of one block; a block of items goes to every task.
BLOCK_CELLS = 1 << 22
#: Documents times terms held densely at once in a task.
DENSE_CELLS = 1 << 21
#: Children of a node.
FAN = 8
#: A first round over one document in so many gives the first thresholds.
SEED_SHARE = 64
_IDS_LAST = 1 << 63


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats; none for null."""
    return text.translate(TERM_BYTES).split() if text else []


@dataclass
class Block:
    """Items that are searched together: ids, their terms' counts, and the terms' places."""

    ids: list
    counts: list
    places: dict


def blocks(items: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[Block]:
    """Items in blocks of at most ``most`` cells; the driver holds one block at a time.

    An item with more terms than a block may have is a block of its own.
    """
    rows = items.select(F.col(item_col).cast("long"), F.col(text_col).cast("binary"))
    block = Block([], [], {})
    for item_id, text in rows.toLocalIterator():
        counts = Counter(terms(bytes(text) if text is not None else None))
        if not counts:
            continue
        new = sum(t not in block.places for t in counts)
        if block.ids and (len(block.ids) + 1) * (len(block.places) + new) > most:
            yield block
            block = Block([], [], {})
        block.ids.append(item_id)
        block.counts.append(counts)
        for t in counts:
            block.places.setdefault(t, len(block.places))
    if block.ids:
        yield block


def vectors(docs: DataFrame, places, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs``: of every document with a term, all its terms' number and those of the items.

    ``places`` is a broadcast dictionary from a term to its place.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in slices(batches, "text"):
            ids, ns, at, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(text)
                if not found:
                    continue
                own = sorted((known[t], c) for t, c in Counter(found).items() if t in known)
                ids.append(doc_id)
                ns.append(len(found))
                at.append([p for p, _ in own])
                tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"]
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return plain.mapInArrow(encode, "doc_id long, n long, terms array<int>, tfs array<long>")


class ItemTree:
    """Items in the order of their tree, and the levels above them as ranges of that order."""

    def __init__(self, points: np.ndarray):
        self.order = np.array(_arranged(points, np.arange(len(points))), dtype=np.int64)
        self.levels = [(points[self.order], np.arange(len(points) + 1))]
        while len(self.levels[-1][0]) > 1:
            below, starts = self.levels[-1]
            cuts = np.arange(0, len(below), FAN)
            self.levels.append((np.maximum.reduceat(below, cuts), np.append(starts[cuts], len(points))))

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes of the level below; of single items, the items themselves."""
        if level == 0:
            return nodes
        below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return below[below < len(self.levels[level - 1][0])]


def _arranged(points: np.ndarray, rows: np.ndarray) -> list[int]:
    """Rows in an order in which alike ones are close, by repeated halving between two distant rows."""
    out, stack = [], [rows]
    while stack:
        own = stack.pop()
        if len(own) <= FAN:
            out.extend(own.tolist())
            continue
        near = points[own] @ points[own[0]]
        one = own[int(np.argmin(near))]
        side = points[own] @ (points[one] - points[own[int(np.argmin(points[own] @ points[one]))]])
        ranked = own[np.argsort(-side, kind="stable")]
        stack += [ranked[len(ranked) // 2 :], ranked[: len(ranked) // 2]]
    return out


class Search:
    """The best ``k`` documents of each item among those given to ``add``."""

    def __init__(self, points: np.ndarray, floors: np.ndarray, k: int):
        self.tree, self.k = ItemTree(points), k
        #: Scores under an item's floor do not count: k others reach it.
        self.kth = np.maximum(floors[self.tree.order], 1).astype(points.dtype)
        self.heaps: list[list] = [[] for _ in points]
        #: Pairs of nodes whose bound was computed.
        self.bounded = 0
        self._weaken()

    def _weaken(self) -> None:
        self.weakest = [np.minimum.reduceat(self.kth, starts[:-1]) for _, starts in self.tree.levels]

    def add(self, rows: np.ndarray, ids: list) -> None:
        """Search a batch: one row of coordinates for each document, alike ones close together."""
        tiers = [rows]
        while len(tiers[-1]) > 1:
            tiers.append(np.maximum.reduceat(tiers[-1], np.arange(0, len(tiers[-1]), FAN)))
        top = len(self.tree.levels) - 1
        stack = [(len(tiers) - 1, 0, top, np.arange(len(self.tree.levels[top][0])))]
        while stack:
            tier, node, level, active = stack.pop()
            if tier == 0 and level == 0:
                self._score(rows[node : node + 1], ids[node : node + 1], active)
                continue
            bounds = self.tree.levels[level][0][active] @ tiers[tier][node]
            active = active[bounds >= self.weakest[level][active]]
            self.bounded += len(bounds)
            if not len(active):
                continue
            if level:
                active, level = self.tree.children(level, active), level - 1
            if tier == 1 and level == 0:
                inside = slice(node * FAN, min(node * FAN + FAN, len(rows)))
                self._score(rows[inside], ids[inside], active)
            elif tier == 0:
                stack.append((0, node, level, active))
            else:
                last = min(node * FAN + FAN, len(tiers[tier - 1]))
                stack += [(tier - 1, child, level, active) for child in range(node * FAN, last)]

    def _score(self, rows: np.ndarray, ids: list, active: np.ndarray) -> None:
        """Scores of single items with single documents, kept where they reach the k-th."""
        scores = self.tree.levels[0][0][active] @ rows.T
        changed = False
        for i, j in zip(*np.nonzero(scores >= self.kth[active][:, None])):
            item, entry = active[i], (int(scores[i, j]), -ids[j])
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k and heap[0][0] > self.kth[item]:
                self.kth[item], changed = heap[0][0], True
        if changed:
            self._weaken()

    def found(self) -> Iterator[tuple[int, int, int]]:
        for place, heap in enumerate(self.heaps):
            for score, doc_id in heap:
                yield int(self.tree.order[place]), -doc_id, score


def weights(block: Block, df: dict, n_docs: int) -> np.ndarray:
    """Items as rows: their terms' counts times the terms' weights."""
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(p, 0) + 1))) for p in range(len(block.places))], dtype=np.int64)
    points = np.zeros((len(block.ids), len(w)), dtype=np.int64)
    for i, counts in enumerate(block.counts):
        for t, c in counts.items():
            points[i, block.places[t]] = c
    points *= w
    # Sums of doubles are exact integers up to 2^53; a coordinate of a document is below 10^6.
    return points.astype(np.float64) if points.sum(axis=1).max(initial=0) < 2**53 // 10**6 else points


def _best(found: DataFrame, points, floors, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """``item, doc_id, score``: the best of each task of ``found``, which is a table of vectors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Search(points.value, floors.value, k)
        width = own.tree.levels[0][0].shape[1]
        height = max(1, DENSE_CELLS // width)
        for rows in _chunks(batches, height):
            ids, ns, at, tfs = rows
            dense = np.zeros((len(ids), width), dtype=points.value.dtype)
            for r, (n, where, tf) in enumerate(zip(ns, at, tfs)):
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                tf = np.asarray(tf, dtype=np.int64)
                dense[r, where] = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
            own.add(dense, [_IDS_LAST if i is None else i for i in ids])
        out = list(own.found())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([None if x[1] == _IDS_LAST else x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
            ["item", "doc_id", "score"],
        )

    return found.mapInArrow(search, "item int, doc_id long, score long")


def _chunks(batches: Iterable[pa.RecordBatch], height: int) -> Iterator[tuple[list, list, list, list]]:
    """Columns of at most ``height`` rows at once, across Arrow batches."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    for batch in batches:
        for start in range(0, batch.num_rows, height):
            for column, more in zip(held, batch.slice(start, height).columns):
                column.extend(more.to_pylist())
            while len(held[0]) >= height:
                yield tuple(c[:height] for c in held)
                held = tuple(c[height:] for c in held)
    if held[0]:
        yield held


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Rows with their rank within the item, ``k`` at most; first within shares of the tasks."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    shared = rows.withColumn("_share", F.spark_partition_id() % 64)
    first = shared.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_share").orderBy(*best))).filter(F.col("rank") <= k)
    return first.drop("_share").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", most: int = BLOCK_CELLS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, exactly.

    Items go in blocks of ``most`` cells (items times their distinct terms), each
    searched through all documents. A null or empty text has no terms: such a
    document is never found, and such an item gives no rows. Every row of either
    table counts by itself, so repeated rows take ranks of their own; equal scores
    go by id, null ids last. Long texts are read whole. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items, item_col, text_col, most):
        out = out.unionByName(_ranked_block(spark, docs, block, k, id_col, text_col))
    return out


def _ranked_block(spark: SparkSession, docs: DataFrame, block: Block, k: int, id_col: str, text_col: str) -> DataFrame:
    """The ranking of one block: vectors, counts, first thresholds, then all documents."""
    send = spark.sparkContext.broadcast
    held = materialize(vectors(docs, send(block.places), id_col, text_col), "search-vectors")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    points = send(weights(block, df, n_docs))
    floors = np.ones(len(block.ids), dtype=np.int64)
    found = held.filter(F.size("terms") > 0)
    # Any k documents give a threshold that the final k-th score reaches.
    seeds = found.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_SHARE)) == 0)
    for row in _top(_best(seeds, points, send(floors.copy()), k, n_docs, n_terms), k).filter(F.col("rank") == k).collect():
        floors[row["item"]] = row["score"]
    ids = F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long"))
    return _top(_best(found, points, send(floors), k, n_docs, n_terms), k).join(ids, "item").select("item_id", "rank", "doc_id", "score")


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item, over whole tables; edge cases as in ``rank``."""
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = f"""WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_RUN}')) AS t FROM documents),
lens AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM lens),
q AS (
  SELECT item_id, t, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_RUN}')) AS t FROM benchmark) GROUP BY 1, 2),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
ws AS (SELECT t, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY t, nn),
scores AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score
  FROM q JOIN ws USING (t) JOIN tfs USING (t) JOIN lens USING (doc_id), totals GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""

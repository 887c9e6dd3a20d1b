"""N-best segmentation into pieces, and decoding (operator 8).

A text's lattice has an edge for each piece that matches at a position, and one
edge of byte pieces for each code point. Forward Viterbi scores are exact
heuristics for a backward A-star search, so hypotheses leave its queue in order
of their full score. No piece reaches from a word into the next mark of a space,
over a line break, or from letters to other signs, so the lattice falls into
units there. A batch's distinct units are searched side by side and remembered;
the best segmentation of each text is gathered from them as arrays, and its
n best are the cheapest combinations of its units' alternatives.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices, texts_of

SPACE = "\u2581"
BEST = 3
#: Units that a task remembers before it starts afresh, and the longest searched as arrays.
CACHE_ENTRIES, ALIKE_CHARS = 300_000, 40
#: Units whose alternatives a task remembers, and bytes of text in a batch.
ALTERNATIVES, BATCH_BYTES = 20_000, 3 << 19
#: Cost of a byte piece in millionths, so that bytes stand in only where pieces lack.
BYTE_COST = 14_000_000
#: Stands for no segmentation.
_NONE = -(1 << 60)
_STEP, _SLOT_FACTOR, _SLOT_SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(44)
_UNITS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_FINE_UNITS = re.compile(f"\n|{SPACE}*[^\\W\\d_]+|{SPACE}*(?:[\\d_]|[^\\w{SPACE}\n])+|{SPACE}+")
#: Stands for a mark that the text itself holds; spelled in bytes, in one way.
_LITERAL = SPACE + "\n"


def _processor(model: str | None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))


def _spells(processor, i: int, piece: str) -> bool:
    """Whether a piece stands for text, and lies within a unit."""
    return not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i) or "\n" in piece or re.search(f"[^{SPACE}]{SPACE}", piece))


@functools.lru_cache(maxsize=1)
def spelled_pieces(model: str | None) -> list[bytes]:
    """The bytes that each id stands for, none for control ids."""
    processor = _processor(model)
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace(SPACE, " ").encode() if _spells(processor, i, piece) else b"")
    return out


class Pieces:
    """Pieces of a model file with log-probabilities, and the lattice search.

    The file orders pieces by merge rank and has no probabilities; by Zipf's law
    the piece of rank r scores ``-log(r + 10)`` up to a constant. Scores are whole
    millionths, so that sums are exact and equal hypotheses stay equal.
    """

    def __init__(self, model: str | None = None):
        processor = _processor(model)
        self.ids: dict[str, tuple[int, int]] = {}
        self.byte_ids = [0] * 256
        constant = math.log(sum(1 / (r + 10) for r in range(processor.get_piece_size())))
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif _spells(processor, i, piece):
                self.ids[piece] = (i, round(-1e6 * (math.log(len(self.ids) + 10) + constant)))
        self.longest = max(map(len, self.ids))
        #: What any piece begins with, for the search to stop early.
        self.begins: dict[str, tuple[int, int] | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))} | self.ids
        hashed = {p: self._hash(p) for p in self.ids}
        if len(set(hashed.values())) < len(hashed):
            raise ValueError("two pieces share a hash")
        ordered = sorted(self.ids, key=lambda p: self._slot(hashed[p]))
        # a table from a slot of the hash to its first piece; the last, empty row ends a slot
        self.keys = np.array([*(hashed[p] for p in ordered), 0], np.uint64)
        self.key_ids, self.key_scores = (np.array([*(self.ids[p][i] for p in ordered), (-1, 2 * _NONE)[i]], np.int64) for i in (0, 1))
        slots, none = self._slot(self.keys[:-1]), len(ordered)
        self.slot = np.full(1 << (64 - int(_SLOT_SHIFT)), none, np.int32)
        self.slot[slots[::-1]] = np.arange(none)[::-1]
        self.following = np.full(none + 1, none, np.int32)
        self.following[:-2][slots[1:] == slots[:-1]] = np.flatnonzero(slots[1:] == slots[:-1]) + 1
        # letters and other signs never share a piece in most models: then a unit ends there
        letter = re.compile(r"[^\W\d_]")
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1) if p[k] != SPACE}
        self.units = _UNITS if any(bool(letter.match(a)) != bool(letter.match(b)) for a, b in pairs) else _FINE_UNITS

    def units_of(self, text: str) -> list[str]:
        """The units of a text; literal marks come as ``_LITERAL``."""
        if SPACE not in text:
            return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []
        first, *rest = text.split(SPACE)
        out = self.units.findall(SPACE + first.replace(" ", SPACE))
        for part in rest:
            out += [_LITERAL, *self.units.findall(part.replace(" ", SPACE))]
        return out

    @staticmethod
    def _slot(hashes):
        with np.errstate(over="ignore"):
            return (np.asarray(hashes, np.uint64) * _SLOT_FACTOR) >> _SLOT_SHIFT

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, unit: str, end: int) -> Iterator[tuple[int, tuple[int, ...], int]]:
        """(start, ids, score) of the edges that end at ``end``."""
        for start in range(max(0, end - self.longest), end):
            found = self.ids.get(unit[start:end])
            if found:
                yield start, (found[0],), found[1]
        data = unit[end - 1].encode()
        yield end - 1, tuple(self.byte_ids[b] for b in data), -BYTE_COST * len(data)

    def forward(self, unit: str) -> tuple[list[int], list, int]:
        """Viterbi scores, back edges, and the second-best full score."""
        begins, longest, n = self.begins, self.longest, len(unit)
        best, second, back = [0] + [_NONE] * n, [_NONE] * (n + 1), [None] * (n + 1)
        for start in range(n):
            first, other = best[start], second[start]
            char = unit[start]
            size = 1 if char < "\x80" else len(char.encode())
            edges = [(start + 1, -1, -BYTE_COST * size)]
            for end in range(start + 1, min(n, start + longest) + 1):
                piece = unit[start:end]
                if piece not in begins:
                    break
                found = begins[piece]
                if found is not None:
                    edges.append((end, *found))
            for end, piece, score in edges:
                s = first + score
                if s > best[end]:
                    second[end] = best[end]
                    best[end], back[end] = s, (start, piece)
                elif s > second[end]:
                    second[end] = s
                s = other + score
                if s > second[end]:
                    second[end] = s
        return best, back, second[n]

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the pieces with these hashes; the last row where there is none."""
        at = self.slot[self._slot(hashes)]
        wrong = self.keys[at] != hashes
        while True:
            more = wrong & (at < len(self.keys) - 1)
            if not more.any():
                return at
            at[more] = self.following[at[more]]
            wrong[more] = self.keys[at[more]] != hashes[more]

    def search_alike(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best ids in a row, their numbers, scores, and gaps to the second best, of units of one length."""
        n, k = len(units[0]), len(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").reshape(k, n).T.astype(np.uint64)
        sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        best, second = np.full((n + 1, k), _NONE), np.full((n + 1, k), _NONE)
        best[0] = 0
        starts_at, ids_at = np.zeros((n + 1, k), np.int64), np.zeros((n + 1, k), np.int64)
        hashes, every = np.zeros((n, k), np.uint64), np.arange(k)
        for end in range(1, n + 1):
            low = max(0, end - self.longest)
            hashes[low:end] = hashes[low:end] * _STEP + codes[end - 1] + np.uint64(1)
            at = self._places(hashes[low:end])
            score = self.key_scores[at]
            first = np.concatenate([best[low:end] + score, (best[end - 1] - BYTE_COST * sizes[end - 1])[None]])
            top = first.argmax(axis=0)
            best[end] = first[top, every]
            by_byte = top == end - low
            piece = np.minimum(top, end - low - 1)
            starts_at[end] = np.where(by_byte, end - 1, low + piece)
            ids_at[end] = np.where(by_byte, -1, self.key_ids[at[piece, every]])
            first[top, every] = 2 * _NONE
            others = np.maximum((second[low:end] + score).max(axis=0), second[end - 1] - BYTE_COST * sizes[end - 1])
            second[end] = np.maximum(np.maximum(first.max(axis=0), others), _NONE)
        # from the end back, all units in step; a byte edge holds its place with -1 for each byte
        found, end = [], np.full(k, n)
        while end.any():
            live = end > 0
            own, start = ids_at[end, every], starts_at[end, every]
            spelled = live & (own < 0)
            found.append(np.where(live & ~spelled, own, -1))
            if spelled.any():
                char = codes[np.maximum(end, 1) - 1, every].astype(np.int64)
                width = np.where(spelled, sizes[np.maximum(end, 1) - 1, every], 0)
                for b in range(int(width.max())):  # the last byte first
                    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width]
                    byte = np.where(b == width - 1, lead | (char >> (6 * b)), 0x80 | (char >> (6 * b)) & 0x3F)
                    found.append(np.where(b < width, np.array(self.byte_ids)[byte & 0xFF], -1))
            end = np.where(live, start, 0)
        steps = np.stack(found[::-1], axis=1) if found else np.empty((k, 0), np.int64)
        there = steps >= 0
        return steps[there], there.sum(axis=1), best[n], best[n] - second[n]

    def best_ids(self, unit: str, back: list) -> list[int]:
        out, end = [], len(unit)
        while end:
            start, piece = back[end]
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(unit[start].encode())]
            end = start
        return out[::-1]

    def n_best(self, unit: str, n: int, forward: list[int] | None = None) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best (score, ids), by backward A-star; fewer if none are left."""
        forward = forward or self.forward(unit)[0]
        # of equal hypotheses the one nearest to the start comes first; each links to the rest of its ids
        queue: list = [(-forward[-1], len(unit), 0, 0, None)]
        out, pushed = [], 0
        while queue and len(out) < n:
            _, end, _, suffix, ids = heapq.heappop(queue)
            if end == 0:
                found: list[int] = []
                while ids is not None:
                    found += ids[0]
                    ids = ids[1]
                out.append((suffix, tuple(found)))
                continue
            for start, piece, score in self.edges(unit, end):
                pushed += 1
                heapq.heappush(queue, (-(forward[start] + suffix + score), start, pushed, suffix + score, (piece, ids)))
        return out


class _Rows:
    """A growing array."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1 << 16, dtype), 0

    def extend(self, values: list | np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Segmenter:
    """Finds the ``n`` best of texts; remembers units and what it found for them."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.scores, self.gaps, self.starts, self.sizes, self.ids = _Rows(np.int64), _Rows(np.int64), _Rows(np.int64), _Rows(np.int64), _Rows("<u4")
        self.options: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

    def _learn(self, units: set[str]) -> None:
        """Search units that are not known yet, those of one length side by side."""
        by_length: dict[int, list[str]] = {}
        for unit in units:
            if len(unit) <= ALIKE_CHARS and unit != _LITERAL:
                by_length.setdefault(len(unit), []).append(unit)
            elif unit == _LITERAL:
                own = [self.pieces.byte_ids[b] for b in SPACE.encode()]
                self._add([unit], own, [len(own)], [-BYTE_COST * len(own)], [1 << 61])
            else:
                best, back, second = self.pieces.forward(unit)
                own = self.pieces.best_ids(unit, back)
                self._add([unit], own, [len(own)], [best[-1]], [best[-1] - second])
        for same in by_length.values():
            for i in range(0, len(same), 4096):
                self._add(same[i : i + 4096], *self.pieces.search_alike(same[i : i + 4096]))

    def _add(self, units: list[str], ids, sizes, scores, gaps) -> None:
        self.row.update(zip(units, range(len(self.row), len(self.row) + len(units)), strict=True))
        self.starts.extend(self.ids.n + np.cumsum(sizes) - sizes)
        for rows, values in ((self.ids, ids), (self.sizes, sizes), (self.scores, scores), (self.gaps, gaps)):
            rows.extend(values)

    def _alternatives(self, unit: str, n: int) -> list[tuple[int, bytes]]:
        """(loss, packed ids) of a unit's 2nd to ``n``-th best."""
        if unit == _LITERAL:
            return []
        key = (unit, n)
        found = self.options.get(key)
        if found is None:
            ranked = self.pieces.n_best(unit, n)
            found = [(ranked[0][0] - s, np.array(ids, dtype="<u4").tobytes()) for s, ids in ranked[1:]]
            if len(unit) <= ALIKE_CHARS:
                if len(self.options) >= ALTERNATIVES:
                    self.options.clear()
                self.options[key] = found
        return found

    def segment(self, texts: list[str], n: int) -> list[list[tuple[int, bytes]]]:
        """The ``n`` best (score, packed ids) of each text, best first.

        Only the n - 1 units with the least gaps can differ from the best choice
        in one of the n best; ties go to the earlier unit.
        """
        if len(self.row) > CACHE_ENTRIES:
            self._forget()
        units = [self.pieces.units_of(t) for t in texts]
        flat = [u for own in units for u in own]
        rows = np.fromiter(map(self.row.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        lacking = np.flatnonzero(rows < 0).tolist()
        if lacking:
            self._learn({flat[i] for i in lacking})
            rows[lacking] = [self.row[flat[i]] for i in lacking]
        scores, gaps, sizes = self.scores.data[rows], self.gaps.data[rows], self.sizes.data[rows]
        ends = np.cumsum(sizes)
        ids = self.ids.data[np.repeat(self.starts.data[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        out, at = [], 0
        for own in units:
            if not own:
                out.append([(0, b"")])
                continue
            here = slice(at, at + len(own))
            at += len(own)
            first = int(ends[here.start] - sizes[here.start])
            best = ids[first : int(ends[here.stop - 1])].tobytes()
            total = int(scores[here].sum())
            out.append([(total, best)] if n == 1 else self._ranked(own, total, best, gaps[here].copy(), 4 * (ends[here] - first), 4 * sizes[here], n))
        return out

    def _ranked(self, units: list[str], total: int, best: bytes, gaps: np.ndarray, ends: np.ndarray, sizes: np.ndarray, n: int) -> list[tuple[int, bytes]]:
        near = []
        for _ in range(min(n - 1, len(units))):
            near.append(int(gaps.argmin()))
            gaps[near[-1]] = 1 << 62
        near.sort()
        options = [self._alternatives(units[i], n) for i in near]
        places = [(int(ends[i] - sizes[i]), int(ends[i])) for i in near]
        out = [(total, best)]
        # combinations by rising loss: a state is the option taken in each near unit
        queue, seen = [(0, (0,) * len(near))], {(0,) * len(near)}
        while queue and len(out) < n:
            loss, state = heapq.heappop(queue)
            if any(state):
                parts, done = [], 0
                for (start, end), s, choice in zip(places, state, options, strict=True):
                    if s:
                        parts += [best[done:start], choice[s - 1][1]]
                        done = end
                out.append((total - loss, b"".join([*parts, best[done:]])))
            for k, s in enumerate(state):
                if s < len(options[k]):
                    after = state[:k] + (s + 1,) + state[k + 1 :]
                    if after not in seen:
                        seen.add(after)
                        heapq.heappush(queue, (loss + options[k][s][0] - (options[k][s - 1][0] if s else 0), after))
        return out


def encode_nbest(docs: DataFrame, *, n: int = BEST, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, rank, score, token_ids``: the ``n`` best segmentations.

    ``token_ids`` are little-endian unsigned 32-bit ids. Ranks start at 1; a
    text with fewer segmentations has fewer rows, and a null or empty one a
    single row without ids. Repeated rows and null ids each come back; other
    columns are ignored; an empty table gives none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(Pieces(model))
        for batch in slices(batches, "text", BATCH_BYTES):
            found = segmenter.segment(batch["text"].to_pylist(), n)
            rows = [(doc_id, rank, score / 1e6, ids) for doc_id, own in zip(batch["doc_id"].to_pylist(), found, strict=True) for rank, (score, ids) in enumerate(own, 1)]
            types = [pa.int64(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "rank", "score", "token_ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(each, "doc_id long, rank int, score double, token_ids binary")


def decode(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """Add ``text``, decoded from ``token_ids``; null ids give null.

    Ids outside the model and control ids decode to nothing; bytes that are no
    text become replacement characters. The space before the text is taken off.
    Every row is decoded by itself, repeated ones too; no ids give an empty text,
    and an empty table gives none.
    """
    without = encoded.drop("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spelled_pieces(model)
        sizes = np.array([len(x) for x in table])
        starts, spelled = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), np.uint8)
        for batch in slices(batches, "token_ids", 4 << 20):
            texts = []
            for data in batch["token_ids"].to_pylist():
                if data is None:
                    texts.append(None)
                    continue
                ids = np.frombuffer(data, "<u4")
                ids = ids[ids < len(table)]
                own = sizes[ids]
                ends = np.cumsum(own)
                raw = spelled[np.repeat(starts[ids] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
                texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return without.mapInArrow(each, StructType([*without.schema.fields, StructField("text", StringType())]))


def op8_nbest_pieces(spark, sf_dir: str) -> DataFrame:
    """The best segmentations of all documents, and what they decode to; edge cases as in ``encode_nbest`` and ``decode``."""
    decoded = decode(encode_nbest(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return decoded.select(
        "doc_id",
        "rank",
        "score",
        (F.length("token_ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("token_ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("n_chars"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )

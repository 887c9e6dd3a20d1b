"""Packing by power-of-two decomposition (operator 2).

Every document becomes token ids and one end id, and is cut into pieces whose
lengths are powers of two: as many of the longest length as fit, then the
binary digits of the rest from large to small. Each piece is a sequence of its
own, so that no sequence crosses documents and none needs padding; sequences of
one length form a bucket, from which batches are drawn. Nothing is shuffled.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

PIECES = "doc_id long, start long, length long, doc_tokens long, token_ids binary"
END_ID = 1
LONGEST = 2048
#: Distinct chunks that a task remembers, and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 48

#: A space beside other white space or at an end: such texts are encoded whole.
_MIXED_SPACE = re.compile(r" \s|\s |^ | $")
#: White space but for spaces and line breaks, by far the most frequent.
_RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def _mixed_space(text: str) -> bool:
    """Whether ``_MIXED_SPACE`` finds anything, mostly without the pattern."""
    if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in _RARE_SPACE) and _MIXED_SPACE.search(text) is not None


_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class _Chunks(dict):
    """Remembers the encoded form of chunks; starts afresh when full.

    ``lead`` is put before each chunk; ``plain`` remembers chunks without any.
    The split into words cuts between a letter or digit and the signs at a
    chunk's end, and around a single line break, so what stands there is looked
    up by itself.
    """

    def __init__(self, encode: Callable[[str], bytes], lead: str, plain: _Chunks | None = None):
        super().__init__()
        self.encode, self.lead, self.plain = encode, lead, self if plain is None else plain

    def __missing__(self, chunk: str) -> bytes:
        if "\n" in chunk:
            lines = chunk.split("\n")
            if lines == chunk.split():
                line = self.plain["\n"]
                return self[lines[0]] + b"".join([line + self.plain[x] for x in lines[1:]])
        word = chunk.rstrip(_SIGNS)
        if word and word is not chunk and word[-1].isalnum():
            value = self[word] + self.plain[chunk[len(word) :]]
        else:
            value = self.encode(self.lead + chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = value
        return value


def _spelled_bytes() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary.

    Bytes that print stand for themselves, the others for the signs from 256 on.
    """
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or (b >= 161 and b != 173):
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


def byte_encoder(vocabulary: str | None = None) -> Callable[[str], bytes]:
    """A function from text to little-endian 32-bit ids, as the tokenizer gives them.

    ``vocabulary`` is the tokenizer's JSON file; the default is the public
    byte-level one. A special token's string in a text becomes that token. The
    split into words never joins what a single space between two other
    characters separates, so a text is encoded chunk by chunk, and frequent
    chunks are encoded once per worker.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    merge, spelled = tokenizer.model.tokenize, _spelled_bytes()

    def plain(text: str) -> bytes:
        if text.isalpha() or (text[:1] == " " and text[1:].isalpha()):  # one word: its pieces need no split
            ids = [x.id for x in merge(text.encode().decode("latin-1").translate(spelled))]
        else:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    first = _Chunks(plain, "")
    spaced = _Chunks(plain, " ", first)

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if _mixed_space(text) or any(s in text for s in special):
            return plain(text)
        head, *rest = text.split(" ")
        return first[head] + b"".join(map(spaced.__getitem__, rest))

    return encode


def binary_lengths(n: int, longest: int) -> Iterator[int]:
    """Powers of two from large to small, none over ``longest``, with sum ``n``."""
    for _ in range(n // longest):
        yield longest
    n %= longest
    while n:
        part = 1 << (n.bit_length() - 1)
        yield part
        n -= part


def split_documents(
    docs: DataFrame,
    *,
    longest: int = LONGEST,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, token_ids``.

    ``token_ids`` holds the piece's ids as little-endian unsigned 32-bit values.
    ``longest`` must be a power of two. Null and empty texts are the end id
    alone. Repeated rows and null ids are cut like any other row; other columns
    of ``docs`` are ignored, whatever their names; an empty table gives none.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = byte_encoder(vocabulary), struct.pack("<I", end_id)
        for batch in slices(batches, "text"):
            ids, starts, lengths, totals, tokens = [], [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = encode(text) + end
                total, start = len(data) // 4, 0
                for length in binary_lengths(total, longest):
                    ids.append(doc_id)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(total)
                    tokens.append(data[4 * start : 4 * (start + length)])
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, starts, lengths, totals)] + [pa.array(tokens, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "token_ids"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(cut, PIECES)


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Add ``bucket`` (log2 of the length), ``sequence_id`` and ``offset``.

    A sequence's id starts with its bucket, so sorting by it lists each bucket
    as one run. Ids are unique within a result, not the same from run to run;
    write the result before joining on them. Up to 2^25 partitions fit. Every row
    is a piece and a sequence of its own, repeated ones too; an empty table gives
    none.
    """
    bucket = F.log2("length").cast("int")
    return (
        pieces.withColumn("bucket", bucket)
        .withColumn("sequence_id", F.shiftleft(F.col("bucket").cast("long"), 58) + F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )


def pack(docs: DataFrame, **options) -> DataFrame:
    """Sequences with their token ids; ``options`` and edge cases as for ``split_documents``."""
    return number_sequences(split_documents(docs, **options))


def op2_power_of_two_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, one row per piece; edge cases as in ``split_documents``."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("token_ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )

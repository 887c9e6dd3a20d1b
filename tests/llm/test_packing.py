import struct
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from feedloom.llm import packing

from .conftest import SF, TRICKY


def reference_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_chunked_encoder_equals_tokenizer(documents):
    encode = packing.byte_encoder()
    texts = [r.text for r in documents.select("text").collect()] + [t or "" for _, t in TRICKY[:8]]
    texts += ["a  b", " a", "a ", "a \n b", "a\n\nb c", "it's they'll 12 34", "<|endoftext|> x", "x <|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "a　 b", "a\x1c b", "one.\ntwo, (three)\nfour! five", "a\n\nb.", "x»., y", "dogs' it's.\nx", "²., ½!", "word\r\nword", "\nx", "x\n"]
    for text, ids in zip(texts, reference_ids(texts), strict=True):
        data = encode(text)
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == ids[:-1]


def test_binary_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 9999):
        parts = list(packing.binary_lengths(n, 2048))
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)
        assert parts == sorted(parts, reverse=True)


def check_whole(rows, expected):
    """expected: (doc_id, ids) of every row; pieces cover each once."""
    found, wanted = defaultdict(int), defaultdict(int)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048
        found[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    for doc_id, ids in expected:
        start = 0
        for n in packing.binary_lengths(len(ids), 2048):
            part = struct.pack(f"<{n}I", *ids[start : start + n])
            wanted[doc_id, start, n, zlib.crc32(part), len(ids)] += 1
            start += n
    assert found == wanted


def test_query_against_brute_force(spark, documents):
    rows = documents.collect()
    check_whole(packing.op2_power_of_two_packing(spark, SF).collect(), zip([r.doc_id for r in rows], reference_ids([r.text for r in rows]), strict=True))


def test_tricky_rows(tricky):
    from pyspark.sql import functions as F

    rows = packing.pack(tricky).withColumn("ids_crc32", F.crc32("token_ids")).collect()
    check_whole(rows, zip([i for i, _ in TRICKY], reference_ids([t or "" for _, t in TRICKY]), strict=True))
    assert packing.pack(tricky.limit(0)).count() == 0


def test_mixed_space_as_the_pattern():
    import itertools

    for text in map("".join, itertools.product(" \n\ta\u3000\x1c", repeat=4)):
        assert packing._mixed_space(text) == (packing._MIXED_SPACE.search(text) is not None)

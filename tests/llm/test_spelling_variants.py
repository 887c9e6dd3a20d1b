import random
import re
import zlib
from collections import Counter

import pytest

from feedloom.llm import spelling_variants as variants

from .conftest import SF, TRICKY

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def edits(word, letters):
    yield from (word[:i] + word[i + 1 :] for i in range(len(word)))
    for c in letters:
        yield from (word[:i] + c + word[i + 1 :] for i in range(len(word)))
        yield from (word[:i] + c + word[i:] for i in range(len(word) + 1))


def plain_variants(words):
    """Every edit of every word, looked up."""
    letters = sorted(set("".join(words)))
    near = {w: {v for v in edits(w, letters) if v in words} - {w} for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_query_equals_every_edit_looked_up(spark, documents):
    want = plain_variants(plain_words(documents.select("doc_id", "text").collect()))
    assert sum(r[4] > 0 for r in want) > 100
    assert rows(variants.op13_permuterm_variants(spark, SF)) == want


def test_chains_ties_and_words_of_any_length(spark):
    rng = random.Random(5)
    base = {"abcdefg": 20_000, "abcdefgh": 2000, "abcdefghi": 200, "abcdefghij": 20, "abcdefghijk": 2, "aaaaaaa": 2, "aaaaaaaa": 2, "zaaaaaa": 20, "baaaaaa": 20}
    for size in (62, 63, 64, 65, 66, 300):
        word = "".join(rng.choice("abcéÿ×") for _ in range(size))
        base |= {word: 30, word[:-1] + "q": 3, word[:9] + word[10:]: 3, "q" + word: 300, word[:20] + "r" + word[21:]: 300, "s" + word[1:]: 2, "aa" + word: 2, "a" + word: 2}
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(base.items())]
    words = plain_words(docs)
    assert len(words) > 40
    got = rows(variants.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == plain_variants(words)
    assert any(r[1] and r[2] != r[1] for r in got)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_groups_go_on_over_batches(size):
    import pyarrow as pa

    table = [("b$a", x, n, None) for x, n in (("", 4), ("a", 9), ("c", 9), ("d", 1))] + [("c$a", "x", 1, None)] + [("d$a", x, 1, None) for x in "xy"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table[i : i + size]), (pa.string(), pa.string(), pa.int64(), pa.string()))], ["key", "letter", "n", "ref"]) for i in range(0, len(table), size)]
    got = [tuple(r.values()) for b in variants._scan(iter(batches)) for r in b.to_pylist()]
    want = [("aab", 2, 9, "acb"), ("aab", 0, 4, "ab"), ("acb", 2, 9, "aab"), ("acb", 1, 4, "ab"), ("adb", 2, 9, "aab"), ("adb", 1, 4, "ab"), ("ab", 2, 9, "aab"), ("axd", 1, 1, "ayd"), ("ayd", 1, 1, "axd")]
    assert sorted(got) == sorted(want)


def test_tricky_documents_and_empty_tables(spark, tricky):
    docs = tricky.withColumnRenamed("length", "n").withColumnRenamed("key", "word")
    twice = docs.unionByName(docs)
    assert rows(variants.variants(twice)) == plain_variants_of_long(plain_words(TRICKY + TRICKY))
    assert variants.variants(docs.limit(0)).collect() == []


def plain_variants_of_long(words):
    """As ``plain_variants``, leaving out the many edits of one word too long for that: it has no near word."""
    return sorted(plain_variants({w: n for w, n in words.items() if len(w) < 1000}) + [(w, None, w, n, 0, None) for w, n in words.items() if len(w) >= 1000], key=repr)

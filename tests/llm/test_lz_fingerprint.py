import hashlib

import numpy as np

from feedloom.llm import lz_fingerprint as lz

from .conftest import SF, TRICKY


def phrases(text):
    known, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            phrase = ""
    return known


def brute(rows):
    """(doc_id, text) by descending id -> expected columns."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), lz.fingerprint_text(text), lz.fingerprint_text(edited)))
    return out


def test_parse_gives_the_phrases():
    for text in ("", "a", "abababab", "the cat sat on the mat " * 20):
        parser = lz.PhraseParser()
        parser.feed(text)
        assert len(parser.hashes) - 1 == len(phrases(text))


def test_likeness_is_jaccard_for_small_sets():
    a, b = "the cat sat on the mat", "the cat sat on the hat"
    x, y = phrases(a), phrases(b)
    sig = [np.frombuffer(bytes.fromhex(lz.fingerprint_text(t)), ">u4").astype(np.uint32) for t in (a, b)]
    assert abs(lz.likeness(*sig) - len(x & y) / len(x | y)) < 1e-9
    assert lz.likeness(sig[0], sig[0]) == 1.0 and lz.likeness(sig[0], sig[0][:0]) == 0.0


def test_query_against_brute_force(spark, documents):
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    got = {r.doc_id: r for r in lz.op4_lz_fingerprint(spark, SF).collect()}
    assert len(got) == len(rows)
    for want in brute(rows):
        assert tuple(got[want[0]])[:5] == want
    edited = [r.near_edited for r in got.values() if r.n_chars > 100]
    after = [r.near_next for r in got.values() if r.n_chars > 100]
    assert np.median(edited) > 0.4 > 0.2 > np.median(after)


def test_tricky_rows(spark, tricky):
    got = lz.edited_likeness(tricky, ranges=5).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in TRICKY)
    unique = [(i, t or "") for i, t in TRICKY if i is not None and i != 1] + [(1, TRICKY[0][1])] * 2
    want = brute(sorted(unique, reverse=True)[:-1])  # the last is followed by the row without an id
    have = {r.doc_id: tuple(r)[:5] for r in got}
    for w in want:
        if w[0] != 1:
            assert have[w[0]] == w
    assert have[None][2] == brute([(None, TRICKY[10][1]), (10, TRICKY[11][1])])[0][2]
    assert lz.edited_likeness(tricky.limit(0)).count() == 0
    assert [r.near_next for r in lz.edited_likeness(tricky.filter("doc_id = 5")).collect()] == [1.0]
    assert lz.fingerprints(tricky).count() == len(TRICKY)


def plain_fingerprint(text):
    """The smallest distinct 32-bit hashes of the phrases, in plain whole numbers."""
    out = set()
    for phrase in phrases(text):
        h = 0x9E3779B97F4A7C1
        for c in phrase:
            h = (h * 0x5851F42D4C957F2D + ord(c) + 1) % 2**60
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) % 2**64
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) % 2**64
        out.add((h ^ (h >> 31)) >> 32)
    return "".join(f"{x:08x}" for x in sorted(out)[: lz.SIZE])


def test_fingerprints_against_plain_numbers(documents):
    texts = [r.text for r in documents.limit(60).collect()] + ["", "a", "é" * 300, "ab" * 4_000]
    for text in texts:
        assert lz.fingerprint_text(text) == plain_fingerprint(text)

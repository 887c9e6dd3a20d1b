import itertools
import struct
import zlib

import pytest

from feedloom.llm import nbest_pieces as nb

from .conftest import SF, TRICKY


@pytest.fixture(scope="module")
def pieces():
    return nb.Pieces()


def all_segmentations(pieces, unit):
    out = []

    def go(end, score, ids):
        if end == 0:
            out.append((score, ids))
            return
        for start, piece, s in pieces.edges(unit, end):
            go(start, score + s, piece + ids)

    go(len(unit), 0, ())
    return sorted(out, key=lambda x: -x[0])


def test_search_against_enumeration(pieces):
    for unit in ("▁the", "▁hello", "a", "▁é!", "\n", "▁▁x", "▁naïve"):
        want = all_segmentations(pieces, unit)
        got = pieces.n_best(unit, 6)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:6]])
        assert {i for _, i in got} <= {i for _, i in want}
        best, back, second = pieces.forward(unit)
        assert best[-1] == pytest.approx(want[0][0]) and tuple(pieces.best_ids(unit, back)) in {i for s, i in want if s == pytest.approx(want[0][0])}
        if len(want) > 1:
            assert second == pytest.approx(want[1][0])


def test_text_against_enumeration(pieces):
    known = nb.Segmenter(pieces)
    for text in ("to be or", "it is\nso", "a  b", "so, it", "(a1) b_", "x²."):
        whole = all_segmentations(pieces, nb.SPACE + text.replace(" ", nb.SPACE))  # without any units
        totals = [s for s, _ in whole]
        got = known.segment([text], 5)[0]
        assert {ids for _, ids in got} <= {struct.pack(f"<{len(i)}I", *i) for _, i in whole}
        assert [s for s, _ in got] == pytest.approx(totals[:5])
        assert len({ids for _, ids in got}) == 5


def test_query_round_trip(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = nb.op8_nbest_pieces(spark, SF).collect()
    assert {r.doc_id for r in rows if r.rank == 1} == set(texts)
    scores = {}
    for r in rows:
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.n_chars == len(texts[r.doc_id])
        scores.setdefault(r.doc_id, {})[r.rank] = r.score
    for s in scores.values():
        assert sorted(s) == list(range(1, len(s) + 1)) and [s[k] for k in sorted(s)] == sorted(s.values(), reverse=True)


def test_tricky_rows(spark, tricky):
    rows = TRICKY + [(20, "a▁b  ▁"), (21, "▁x"), (22, "\n\n a"), (23, "tab\tnul\x00")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nb.decode(nb.encode_nbest(df, n=2)).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    assert sum(r.rank == 1 for r in got) == len(rows)
    for r in got:
        assert r.text == texts[r.doc_id]
    assert nb.encode_nbest(tricky.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, struct.pack("<2I", 0, 4_000_000)), (3, b"")], "doc_id long, token_ids binary")
    assert [r.text for r in nb.decode(odd).orderBy("doc_id").collect()] == [None, "", ""]


def test_literal_marks_leave_every_unit_open(pieces):
    known = nb.Segmenter(pieces)
    mark = tuple(pieces.byte_ids[b] for b in nb.SPACE.encode())
    assert pieces.units_of("it▁hello so") == ["▁it", nb._LITERAL, "hello", "▁so"]
    for text, units in (("it▁hello so", ["▁it", None, "hello", "▁so"]), ("▁hello", ["▁", None, "hello"]), ("a▁▁is b▁", ["▁a", None, None, "is", "▁b", None])):
        per_unit = [[(-nb.BYTE_COST * 3, mark)] if u is None else all_segmentations(pieces, u)[:12] for u in units]
        totals = sorted((sum(s for s, _ in c) for c in itertools.product(*per_unit)), reverse=True)
        got = known.segment([text], 4)[0]
        assert [s for s, _ in got] == totals[:4] and len({ids for _, ids in got}) == 4
        assert {ids for _, ids in got} <= {struct.pack(f"<{len(x)}I", *x) for x in (sum((i for _, i in c), ()) for c in itertools.product(*per_unit))}


def test_query_against_the_lattice_of_whole_texts(pieces, documents):
    """The n best of a text by one search over its whole lattice."""
    known = nb.Segmenter(pieces)
    texts = [r.text for r in documents.filter("length(text) < 400").limit(40).collect()] + ["x" * 60 + " y", "Ünïcödé 漢字, 12.5% (a_b)\n\tz"]
    for text, got in zip(texts, known.segment(texts, 3), strict=True):
        if nb.SPACE in text or not text:
            continue
        whole = pieces.n_best(nb.SPACE + text.replace(" ", nb.SPACE), 3)
        assert [s for s, _ in got] == [s for s, _ in whole]
        assert got[0][1] == struct.pack(f"<{len(whole[0][1])}I", *whole[0][1]) or whole[0][0] == whole[1][0]


def test_forgetting_changes_nothing(pieces, monkeypatch):
    texts = [f"word{k} other{k % 7}, more" for k in range(60)]
    want = nb.Segmenter(pieces).segment(texts, 3)
    monkeypatch.setattr(nb, "CACHE_ENTRIES", 5)
    known = nb.Segmenter(pieces)
    assert [x for t in texts for x in known.segment([t], 3)] == want

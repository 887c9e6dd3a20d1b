import struct

import corpus_pipeline as cp
from feedloom.llm import near_dedup, ordinal_quality, quality_rules, secrets
from feedloom.llm.common import materialize

from .conftest import SF
from .test_near_dedup import brute
from .test_packing import reference_ids
from .test_spans import brute_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, documents):
    docs = documents
    rules = quality_rules.learn_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = materialize(cp.apply_quality_rules(spark, docs, SF), "kept")
    assert kept.columns == COLUMNS
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == {r.doc_id for r in quality_rules.judge(docs, rules).filter("kept").collect()} and 0 < len(texts) < docs.count()

    good = materialize(cp.apply_quality_classifier(spark, kept, SF), "good")
    model = ordinal_quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in ordinal_quality.score(kept, model).filter("kept").collect()}
    assert good.columns == COLUMNS

    single = materialize(cp.apply_near_dedup(spark, good, SF), "single")
    assert single.columns == COLUMNS
    groups = brute([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in groups.values()})

    clean = cp.apply_secret_scan(spark, single, SF)
    assert clean.columns == COLUMNS
    rows = clean.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in single.collect())
    for r in rows:
        assert not brute_secrets(r.text) and r.n_chars == len(r.text)
        if not brute_secrets(texts[r.doc_id]) and "[secret]" not in r.text:
            assert r.text == texts[r.doc_id]

    packed = cp.apply_packing(spark, clean, SF).collect()
    pieces = {}
    for p in sorted(packed, key=lambda p: p.start):
        pieces.setdefault(p.doc_id, []).extend(struct.unpack(f"<{p.length}I", p.token_ids))
    assert pieces == dict(zip([r.doc_id for r in rows], reference_ids([r.text for r in rows]), strict=True))


def test_nulls_and_empty_tables(spark, tricky):
    assert len(cp.STAGES) == 5
    docs = tricky
    for _, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == tricky.columns
    assert cp.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
    empty = tricky.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert near_dedup.one_of_each(tricky).filter("doc_id is null").count() == 1
    assert secrets.redact(tricky).count() == tricky.count()

import re
from collections import Counter

from pyspark.sql import functions as F

from feedloom.llm import quality_rules as qr

from .conftest import SF, TRICKY


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = set()
    for i, w in enumerate(windows):
        if w in often:
            covered.update(range(i, i + 5))
    n = len(words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_query_against_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = qr.op10_learned_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_tricky_rows(tricky):
    got = qr.judge(tricky, qr.DecisionList([]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    have = Counter((r.doc_id, *(r[n] for n in names)) for r in got.select("doc_id", *names).collect())
    assert have == Counter((i, *brute(t)) for i, t in TRICKY)
    assert qr.judge(tricky.limit(0), qr.DecisionList([])).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rules = qr.learn_rules(docs, labels.filter(half), most_train=5000)
    assert rules.rules and "reject if" in str(rules)
    judged = qr.judge(docs, rules).select("doc_id", "kept").join(labels.filter(~half), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert counts[1, True] > 0.97 * (counts[1, True] + counts.get((1, False), 0))
    assert counts[0, False] > 0.6 * (counts[0, False] + counts.get((0, True), 0))


def test_learning_without_labels(spark, tricky):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert qr.learn_rules(tricky, labels).rules == []
    assert qr.learn_rules(tricky, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 1, 1)], labels.schema)).rules == []


def test_kept_follows_the_printed_list(spark):
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rules = qr.learn_rules(documents, spark.read.parquet(f"{sf}/labels.parquet"), least_precision=0.6, least_covered=1)
    assert rules.rules

    def first_rule(row):
        for line in str(rules).split("\n"):
            number, _, condition = line.partition(": reject if ")
            parts = [x.split() for x in condition.split(" and ")]
            if all(row[f] >= exact[f, op, t] if op == ">=" else row[f] < exact[f, op, t] for f, op, t in parts):
                return int(number)
        return None

    exact = {tuple(str(x).split()): x.threshold for r in rules.rules for x in r}  # the print rounds
    rows = qr.judge(documents, rules).collect()
    for r in rows:
        assert r.rule == first_rule(r) and r.kept == (not r.base_failed and r.rule is None)
    assert any(r.rule for r in rows)

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from feedloom.llm import url_filter as uf

from .conftest import SF

URLS = [
    "http://A.Example.COM/en/1?x=1&y=2#z", "https://www.example.com/en/", "https://m.www.example.com/en/x", "http://notexample.com/en/", "http://net/es/", "http://x.net/es",
    "http://x.net/fr/1", "http://com", "http://com/", "nothing", "", None, "ftp://h?q#f", "http://x.org#frag/://y", "http://é.ORG/ÀB/", "a://b://c.com/d", "http://x.net/es/" + "9" * 20_000,
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for verdict, rule in uf.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def same(rows, urls):
    have = Counter((r.page_id, r.host, r.path, r.rule) for r in rows)
    assert have == Counter((i, *brute(u)[:3]) for i, u in urls)
    verdicts = {i: brute(u)[3] for i, u in urls}
    for r in rows:
        assert r.verdict == verdicts[r.page_id] if r.rule else r.verdict in ("allow", "block")


def test_query_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    df = uf.op5_boosted_url_filter(spark, SF)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    same(df.collect(), [(r.page_id, r.url) for r in pages])


def test_tricky_rows(spark):
    rows = [(i, u, "h", -1) for i, u in enumerate(URLS)] + [(None, "http://x.com/", "h", -1), (0, URLS[0], "h", -1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    same(uf.judge(df).collect(), [(i, u) for i, u, *_ in rows])
    assert uf.judge(df.limit(0)).count() == 0


def test_trees_learn_held_out_urls(spark):
    made = spark.range(4000).selectExpr(
        "concat('http://h', id % 7, if(id % 3 = 0, '.biz/', '.org/'), if(hash(id) % 2 = 0, 'a/b/c/', 'a/'), id) AS url",
        "int((id % 3 = 0) <> (hash(id) % 2 = 0)) AS label",
        "xxhash64(id) % 2 = 0 AS trains",
    )
    model = uf.train(made.filter("trains"))
    scored = model.with_bins(model.with_rates(uf.with_features(uf.with_parts(made.filter("not trains"))))).withColumn("right", (model.probability() >= 0.5).cast("int") == F.col("label"))
    assert scored.agg(F.avg(F.col("right").cast("int"))).first()[0] > 0.97


def test_verdicts_by_walking_the_trees(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    own = uf.with_parts(pages).withColumn("rule", uf.rule_of())
    model = uf.train(own.filter("rule is not null").select("url", (uf.rule_verdict(F.col("rule")) == "block").cast("int").alias("label")))
    assert model.trees
    want = {}
    for r in model.with_rates(uf.with_features(own)).collect():
        bins = {f: sum(x <= r[f] for x in model.cuts[f]) for f in uf.FEATURES}
        total = model.margin
        for tree in model.trees:
            node = 0
            while node in tree.splits:
                feature, cut = tree.splits[node]
                node = 2 * node + (2 if bins[feature] >= cut else 1)
            total += tree.values.get(node, 0.0)
        want[r.page_id] = 1 / (1 + math.exp(-total))
    rows = uf.judge(pages, model).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert abs(r.block_chance - want[r.page_id]) < 1e-9
        if r.rule is None:
            assert r.verdict == ("block" if r.block_chance >= 0.5 else "allow")


def test_training_urls_are_bounded_and_distinct(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('u', id)) AS url", "int(id % 2) AS label")
    got = uf.training_urls(rows, 200).collect()
    assert 100 < len(got) <= 200 and len({r.url for r in got}) == len(got)
    assert uf.training_urls(rows, 5000).count() == 2001

"""Golden values of the score arithmetic, and properties of the writes."""

import pytest
from pyspark.sql import functions as F

from feedloom.functions import scoring, text
from feedloom.operators import dedup, filings, joins, upsert


def column(spark, values, schema, expr):
    df = spark.createDataFrame([(i, v) if not isinstance(v, tuple) else (i, *v) for i, v in enumerate(values)], "i int, " + schema)
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def at(days):
    return as_of() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), days * 86400)


def test_decay_and_gravity(spark):
    days = [0.0, 30.0, 31.0, 45.0, 90.0, 365.0]
    got = column(spark, days, "d double", scoring.decay_weight(at(F.col("d")), as_of()))
    assert got == pytest.approx([1, 1, 0.990636, 0.783011, 0.367656, 0.003622], abs=1e-6)
    got = column(spark, [0.0, 14.0, 15.0, 72.0, 180.0], "d double", scoring.gravity(F.lit(0.8), at(F.col("d")), as_of()))
    assert got == pytest.approx([0.8, 0.8, 0.790457, 0.39886, 0.109138], abs=1e-6)
    assert column(spark, [None], "d timestamp", scoring.gravity(F.lit(0.8), "d", as_of())) == [0.8]


def test_multipliers(spark):
    pairs = [(0.0, 1.05), (0.5, 1.05), (0.85, 1.2), (0.9, 1.05), (-0.9, 1.05), (0.9, 0.8), (0.9923, 1.042), (0.95, 3.0)]
    got = column(spark, pairs, "b double, m double", scoring.asymptotic_multiply("b", "m"))
    assert got == pytest.approx([0, 0.525, 1.0, 0.905, -0.905, 0.9, 0.992623, 1.0], abs=1e-6)
    assert column(spark, [-1.0, 0.4, 0.55, 0.7, 0.87, 1.0, 2.0], "g double", scoring.growth_to_multiplier("g")) == [1, 1, 1.012, 1.025, 1.039, 1.05, 1.05]
    assert column(spark, [1e3, 1e6, 2.5e6, 9e6], "v double", scoring.insider_modifier("v")) == pytest.approx([0.01, 0.01, 0.025, 0.03])


def test_bands(spark):
    rows = [(0.970, 0.02, "VERY_STRONG band; x", "true"), (0.5, 0.0, "NEUTRAL", None), (1.0, 0.0, "", "yes"), (0.9, 0.0, "", "false"), (-0.5, None, None, "1")]
    got = column(spark, rows, "s double, b double, r string, f string", scoring.final_article_score("s", "b", "r", "f"))
    assert got == pytest.approx([0.984, 0.0, 1.0, 0.0, -0.5])


def test_figures_and_text(spark):
    written = ["$1.23B", "€450M", "850K", "$4.1T", "12.4%", "-3.2 bps", "1,234", "", "n/a", None]
    assert column(spark, written, "t string", text.parse_figure("t")) == pytest.approx([1230, 450, 0.85, 4_100_000, 12.4, -0.032, 1234, None, None, None])
    assert column(spark, ["<p>a &amp; b</p>\n c", None], "t string", text.strip_html("t")) == ["a & b c", None]
    assert column(spark, ["http://x/feed.atom", "http://x/rss", "http://x/feed/", "http://x/page", None], "t string", text.classify_feed_url("t")) == ["atom", "rss", "rss", None, None]
    assert column(spark, ["http://a/Default.aspx", "https://www.nasdaq.com/x", "http://z"], "t string", text.detect_platform("t")) == ["q4ir", "nasdaq", "generic"]
    body = "intro\nItem 1. Business\nwe sell\nbolts\nItem 2. Properties\nland"
    assert column(spark, [body, "none", None], "t string", text.find_section("t", r"^Item 1\.", r"^Item 2\.", 100)) == ["Item 1. Business\nwe sell\nbolts", None, None]
    assert column(spark, [1234567.0, 3000.0, 12.0, 2.5e9], "t double", text.format_volume("t")) == ["1.2M", "3K", "12", "2500.0M"]
    assert column(spark, [0.1234, None], "t double", text.format_percent("t")) == ["12.3%", None]
    assert column(spark, ["https://atom.example/x", "https://x/atom/1", "https://x/?type=atom", "https://x/press", "https://x/a.xml"], "t string", text.classify_feed_url("t")) == ["rss", "atom", "atom", None, "rss"]
    assert column(spark, ["https://n/stocks/AB/press-releases", "q=symbol:CD|x", "https://x"], "t string", text.ticker_from_url("t", F.lit("Z"))) == ["ab", "cd", "z"]
    assert column(spark, ["A/B & C"], "t string", text.company_search_url("t", "u?q=")) == ["u?q=A/B%2520%2526%2520C"]


def test_writes_are_idempotent_and_monotone(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d"), (None, "n")], "id int, v string")
    once = upsert.append_new(target, batch, "id", [F.col("v")])
    assert sorted(once.filter("id is not null").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert upsert.append_new(once, batch, "id", [F.col("v")]).filter("id is not null").count() == 3
    old = spark.createDataFrame([("s", "i", 1.02, "old"), ("s", "j", 1.0, "old")], "sector string, industry string, multiplier double, rationale string")
    new = spark.createDataFrame([("s", "i", 1.01, "low", 1), ("s", "j", 1.0, "same", 1), ("s", "j", 1.0, "later", 2)], "sector string, industry string, multiplier double, rationale string, seq int")
    rows = {r.industry: (r.multiplier, r.rationale) for r in upsert.raise_multiplier(old, new, ["sector", "industry"]).collect()}
    assert rows == {"i": (1.02, "old"), "j": (1.0, "later")}
    longer = upsert.keep_longer(spark.createDataFrame([(1, "long text", "o"), (2, None, "o")], "id int, t string, f string"), spark.createDataFrame([(1, "short", "n"), (2, "x", "n"), (3, None, "n")], "id int, t string, f string"), ["id"], "t", ["f"])
    assert sorted(longer.collect()) == [(1, "long text", "n"), (2, "x", "n"), (3, None, "n")]


def test_containing_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    needles, texts = sorted({word(rng.randint(1, 6)) for _ in range(60)}), sorted({word(rng.randint(0, 12)) for _ in range(80)})
    got = joins.containing(spark.createDataFrame([(x,) for x in [*needles, ""]], "n string"), "n", spark.createDataFrame([(x,) for x in texts], "t string"), "t")
    assert sorted((r.n, r.t) for r in got.collect()) == sorted((n, t) for n in needles for t in texts if n in t)


def test_ranks_move_and_append(spark):
    queue = spark.createDataFrame([(5, 1, "2024-01-01"), (6, 2, "2024-01-02"), (7, 2, "2024-01-01")], "id long, rank int, added_at string")
    ids = spark.createDataFrame([(7,), (9,)], "id long")
    assert [(r.id, r.rank) for r in dedup.move_to_front(queue, ids, F.lit("2024-02-01")).orderBy("rank").collect()] == [(7, 1), (9, 2), (5, 3), (6, 4)]
    assert [(r.id, r.rank) for r in dedup.append_rank(queue, ids, F.lit("2024-02-01")).orderBy("rank", "id").collect()] == [(5, 1), (6, 2), (7, 2), (9, 3)]


def test_filing_texts_by_form(spark):
    body = "Preface\nItem 1A. Risk Factors\nmuch    risk\nItem 1B. None\nItem 7. Results\ngrew\nItem 8. Tables\nend"
    rows = [("10-K", body), ("10-K/A", "nothing"), ("NT 10-K", "n" * 9_000), ("8-K", "short"), ("8-K", "x\n" * 20_000 + "Item 5.02 New head\nA. Person\nSignatures"), ("X", "whole"), ("4", None)]
    got = column(spark, rows, "f string, t string", filings.filing_text("f", "t"))
    assert got[0] == "=== RISK FACTORS (Item 1A) ===\nItem 1A. Risk Factors\nmuch risk\n\n=== MANAGEMENT DISCUSSION & ANALYSIS (Item 7) ===\nItem 7. Results\ngrew"
    assert got[1] == "nothing" and len(got[2]) == 8_000 and got[3] == "short" and got[5] == "whole" and got[6] is None
    assert got[4] == "=== Item 5.02: Director/Officer Changes ===\nItem 5.02 New head\nA. Person"


def test_dedup_leaves_no_duplicate_key(spark):
    df = spark.createDataFrame([(1, "s", " A ", 0.1), (2, "s", "a", None), (3, "s", None, 0.2), (4, "s", "", None), (5, None, "a", 0.3)], "id int, k string, title string, score double")
    got = dedup.dedup_titles(df, "k", "title", [F.col("score").isNull(), F.col("id")])
    assert sorted(r.id for r in got.collect()) == [1, 3, 5]


def test_fallback_and_forms(spark):
    a, b = spark.createDataFrame([(1, "p")], "k int, v string"), spark.createDataFrame([(1, "f"), (2, "f")], "k int, v string")
    assert sorted(joins.with_fallback(a, b, "k").collect()) == [(1, "p"), (2, "f")]
    symbols = spark.createDataFrame([(1, True), (2, True), (3, False)], "id long, status boolean")
    registry = [filings.Form("10-K", 1, 1.0, 1, True, 1), filings.Form("6-K", 1, 1.0, 1, False, 1)]
    feeds = spark.createDataFrame([(1,)], "symbol_id long")
    assert sorted(joins.form_assignment(symbols, registry, feeds).collect()) == [(1, "10-K"), (2, "10-K"), (2, "6-K")]
    picks = spark.createDataFrame([("[2] Tech | Software",), ("tech/software",), ("SOFTWARE",), ("the application software kind",), ("other",)], "pick string")
    catalog = spark.createDataFrame([("Tech", "Software"), ("Tech", "Application Software")], "sector_name string, industry_name string")
    assert [r.snapped for r in joins.snap_to_catalog(picks, catalog).orderBy("pick").collect()] == ["Tech | Software", "Tech | Software", "", "Tech | Software", ""]


def test_catalog_entries_that_contain_the_pick(spark):
    catalog = spark.createDataFrame([("Technology", "Semiconductors", 1.2), ("Technology", "Semiconductor Equipment", 1.5), ("Energy", "Oil & Gas", 0.8)], "sector_name string, industry_name string, multiplier double")
    picks = {"Technology | Semicond": "Technology | Semiconductor Equipment", "Tech | Widgets": "Technology | Semiconductor Equipment", "energy": "Energy | Oil & Gas", "Any | oil & gas": "Energy | Oil & Gas", "": "", "Other | None": ""}
    got = joins.snap_to_catalog(spark.createDataFrame([(p,) for p in picks], "pick string"), catalog)
    assert {r.pick: r.snapped for r in got.collect()} == picks
    pairs = {("Tech", "x"): 1.5, ("tech", "Semiconductors"): 1.5, ("technology", "semiconductors"): 1.2, ("ENERG", None): 0.8, ("", "x"): 1.0, (None, "x"): 1.0, ("Other", "x"): 1.0}
    got = joins.cascading_multiplier(spark.createDataFrame(list(pairs), "sector string, pick string"), catalog)
    assert {(r.sector, r.pick): r.multiplier for r in got.collect()} == pairs

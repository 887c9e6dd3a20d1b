import json

from pyspark.sql import functions as F

from feedloom.sources import parse
from feedloom.streaming import jobs

RSS = """<rss><channel><title>c</title>
<item><title>One</title><link>http://x/1</link><pubDate>Mon, 15 Jan 2024 10:00:00 +0000</pubDate><description>d</description><category domain="http://x/rss/stock">Nasdaq:abc</category></item>
<item><title>No link</title><pubDate>Mon, 15 Jan 2024 10:00:00 +0000</pubDate></item>
<item><title>No date</title><link>http://x/3</link></item></channel></rss>"""
ATOM = """<feed><entry><title>Two</title><link href="http://x/2"/><updated>2024-01-16T10:00:00Z</updated></entry></feed>"""


def test_feed_xml(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, "not xml"), (4, None)], "feed_id int, xml string")
    rows = {r.title: r for r in parse.parse_feed_xml(df, "xml").collect()}
    assert set(rows) == {"One", "Two"} and rows["One"].published_at.day == 15 and rows["Two"].url == "http://x/2"
    assert parse.parse_feed_xml(df, "xml", F.lit("2024-02-01").cast("timestamp")).count() == 3
    assert [r.ticker for r in parse.parse_feed_tickers(parse.parse_feed_xml(df, "xml")).collect()] == ["ABC"]


def test_press_json(spark):
    one = lambda body, dialect, **o: [(r.title, r.url) for r in parse.parse_press_json(spark.createDataFrame([(1, json.dumps(body))], "id int, j string"), "j", dialect, **o).collect()]
    assert one({"data": {"rows": [{"title": "t", "url": "u", "created": "Jan 5, 2024"}, {"title": "", "url": "v"}]}}, "nasdaq") == [("t", "u")]
    assert one({"news": [{"title": "t", "link": "u", "publisher": "Wire", "providerPublishTime": 5}, {"title": "n", "link": "v", "publisher": "Blog", "providerPublishTime": 5}]}, "yahoo", publishers=["wire"]) == [("t", "u")]
    item = {"Headline": "t", "LinkToDetailPage": "u", "PressReleaseDate": "01/05/2024"}
    assert one([item], "q4") == one({"items": [item]}, "q4") == one({"GetPressReleaseListResult": [item]}, "q4") == [("t", "u")]


def test_submissions_and_numbers(spark):
    body = {"filings": {"recent": {"form": ["10-K", "8-K"], "filingDate": ["2024-01-02", "2024-01-01"], "accessionNumber": ["00-1-2", "00-3"], "primaryDocument": ["a.htm", ""]}}}
    rows = parse.parse_submissions(spark.createDataFrame([(7, json.dumps(body))], "cik int, j string"), "j", "http://e/").collect()
    assert [(r.cik, r.position, r.form_type, r.url) for r in rows] == [(7, 0, "10-K", "http://e/0012/a.htm")]
    a, b = spark.createDataFrame([("abc", 5)], "ticker string, cik long"), spark.createDataFrame([("ABC", 9), ("x", 1)], "ticker string, cik long")
    assert sorted(parse.build_cik_map(a, b).collect()) == [("ABC", "0000000005"), ("X", "0000000001")]


def test_form4(spark):
    xml = """<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>A B</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner>
    <nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding>
    <transactionAmounts><transactionShares><value>1,000</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""
    rows = parse.parse_form4(spark.createDataFrame([(1, xml), (2, "<x/>")], "id int, xml string"), "xml").collect()
    assert [(r.id, r.owner, r.role, r.kind, r.value) for r in rows] == [(1, "A B", "Director", "purchase", 2500.0)]


def _insider(name="A B", date="<value>2024-01-02</value>", company=" C "):
    return (
        f"<ownershipDocument><issuer><issuerName>{company}</issuerName></issuer><periodOfReport>2024-01-05</periodOfReport><reportingOwner><reportingOwnerId><rptOwnerName>{name}</rptOwnerName></reportingOwnerId></reportingOwner>"
        f"<derivativeTable><derivativeTransaction><transactionDate>{date}</transactionDate><exercisePrice><value>3</value><footnoteId id='F1'/></exercisePrice></derivativeTransaction></derivativeTable></ownershipDocument>"
    )


def test_plain_form4_equals_sparks_reader(spark):
    plain = _insider()
    same = [plain, plain.replace("A B", " É\n"), f'<?xml version="1.0"?>\n{plain}', plain.replace("A B", ""), plain.replace("<value>3</value>", ""), plain.replace("<exercisePrice>", "text<exercisePrice a='1'>")]
    odd = [
        _insider(company="C &lt; D"), plain.replace("<value>3", "<VALUE>3").replace("3</value>", "3</VALUE>"), plain.replace("A B", "A<!-- c -->B"), plain.replace("A B", "<b>A</b>"), plain.replace("A B", "A > B"), plain[:-5], plain.replace("A B", "A\rB"), plain.replace("A B", "\x01"),
        plain.replace("A B", "<![CDATA[A]]>"), plain.replace("<ownershipDocument>", "<ownershipDocument xmlns='u'>"), f"<!-- c -->{plain}", f"{plain}x", "", "x", "<a<b>c>", None, plain.replace("<value>3</value>", "<a>" * 1100 + "</a>" * 1100),
    ]
    df = spark.createDataFrame(list(enumerate(same + odd)), "id int, xml string")
    rows = {r.id: r for r in df.select("id", parse._plain_report_of(F.col("xml")).alias("plain"), parse._insider_report_of(F.col("xml")).alias("spark")).collect()}
    assert [rows[i].plain for i in range(len(same))] == [rows[i].spark for i in range(len(same))] and rows[0].plain.deals[0].exercise == "3"
    assert all(rows[len(same) + i].plain is None for i in range(len(odd)))
    got = {r.id: (r.owner, r.price, str(r.traded_at)) for r in parse.parse_form4(df, "xml").collect()}
    assert got[0] == got[len(same)] == ("A B", 3.0, "2024-01-02") and got[1][0] == "É" and got[3][0] == ""


def test_form4_parses_equal_tags_once():
    parse._insider_places.cache_clear()
    reports = [_insider(f"N{i}", f"<value>2024-01-{i % 28 + 1:02}</value>").encode() for i in range(500)]
    found = [parse._plain_report(r) for r in reports]
    assert [h[3] for h, _ in found] == [f"N{i}" for i in range(500)] and parse._insider_places.cache_info().misses == 1


def test_pages(spark):
    html = '<html><head><link rel="alternate" type="application/rss+xml" href="/feed"></head><body><nav>menu</nav><article>' + "word " * 60 + '<a href="/pressreleases/big-news-12">x</a></article><script>no</script></body></html>'
    df = spark.createDataFrame([(1, "http://x.com/a/b?q", html), (2, None, None), (3, "http://y.com", "<p>short</p>")], "page_id int, url string, html string")
    assert [tuple(r) for r in parse.discover_feed_links(df).collect()] == [(1, "http://x.com/feed", "rss")]
    assert [r.href for r in parse.release_links(df).collect()] == ["/pressreleases/big-news-12"]
    body = {r.page_id: r.body for r in parse.html_to_text(df.select("page_id", "html")).collect()}
    assert body[1].startswith("word word") and "menu" not in body[1] and "no" not in body[1].split()[:60] and body[2] is None and body[3] is None


def test_files(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps([{"symbol": "abc", "company_name": "n", "exchange": "e", "status": "true", "rss_links": ["u", "#", ""]}, {"symbol": "b c", "rss_links": "v"}, {"symbol": "d", "status": "false", "rss_links": "w"}]))
    assert sorted((r.symbol, r.status, r.feed_url) for r in parse.read_watchlist(spark, str(tmp_path / "w.json")).collect()) == [("ABC", True, "u"), ("D", False, "w")]
    (tmp_path / "s.csv").write_text("organization,url\nA,u\nB,u,5\nC,v\n")
    assert sorted(parse.read_source_list(spark, str(tmp_path / "s.csv")).collect()) == [("u", "A"), ("v", "C")]
    rows = [("NYSE:abc", "1.5", 7.9, "86400000", " Tech "), ("X:q", "2", 1.0, None, None), ("NASDAQ:d", "NaN", float("inf"), "2024-01-02", "")]
    screener = spark.createDataFrame(rows, "ticker string, close string, number_of_employees double, earnings_release_next_date string, sector string")
    got = {r.ticker: r for r in parse.normalize_screener(screener, spark.createDataFrame([("ABC",), ("D",)], "ticker string")).collect()}
    assert set(got) == {"ABC", "D"} and (got["ABC"].close_price, got["ABC"].number_of_employees, got["ABC"].sector, got["ABC"].earnings_release_date.day) == (1.5, 7, "Tech", 2)
    assert (got["D"].close_price, got["D"].number_of_employees, got["D"].earnings_release_date.day) == (None, None, 2)


def test_streams_equal_batch(spark, tmp_path):
    rows = [(f"h{i % 7}", i % 3, f"2024-01-01 00:0{i % 10}:00") for i in range(20)]
    df = spark.createDataFrame(rows, "article_hash string, symbol_id long, at string").withColumn("published_at", F.to_timestamp("at")).drop("at")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    symbols = spark.createDataFrame([(0, True), (1, True), (2, False)], "id long, status boolean")
    live = jobs.live_articles(stream, symbols)
    query = live.writeStream.foreachBatch(jobs.append_batches(target, "article_hash")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(r.article_hash for r in spark.read.parquet(target).collect())
    assert len(got) == len(set(got)) and set(got) <= {h for h, _, _ in rows}
    kinds = jobs.throughput(spark.readStream.schema(df.schema).parquet(source).select(F.col("published_at").alias("scored_at"), F.lit("k").alias("kind")))
    assert kinds.isStreaming


def test_late_articles_are_stored(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    # a future date first, then backfilled rows and repeats, each in a batch of its own
    batches = [[("a", 0, "2030-01-01"), ("b", 1, "2024-01-01")], [("c", 0, "2019-05-05"), ("a", 0, "2030-01-01")], [("d", 1, "2024-01-02"), ("c", 0, "2019-05-05"), ("e", 2, "2024-01-02"), ("f", 0, None)]]
    schema = "article_hash string, symbol_id long, at string"
    symbols = spark.createDataFrame([(0, True), (1, True), (2, False)], "id long, status boolean")
    for rows in batches:
        df = spark.createDataFrame(rows, schema).withColumn("published_at", F.to_timestamp("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(source)
        live = jobs.live_articles(spark.readStream.schema(df.schema).parquet(source), symbols)
        live.writeStream.foreachBatch(jobs.append_batches(target, "article_hash")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.article_hash for r in spark.read.parquet(target).collect()) == ["a", "b", "c", "d", "f"]


def test_page_text_ends_at_its_own_closing_tag():
    words = "words of the story " * 12
    body = " ".join(words.split())
    assert parse.page_text(f'<div class="x article-body"><div>{words}</div>after<div><div>deep</div></div></div>outside') == f"{body} after deep"
    assert parse.page_text(f"<article>short</article><main><p>{words}<p>{words}</main>") == f"{body} {body}"
    assert parse.page_text(f'<div id="content"><section>{words}<aside>{words}</aside><script>"</div>"</script></section>end</div>no') == f"{body} end"
    assert parse.page_text(f'<nav><article>{words}</article></nav><div data-testid="my-content">{words}&amp; more</div>') == f"{body} & more"
    assert parse.page_text(f'<div class="contents">{words}</div><p>{words}</p><p>short</p><p>{words}') == f"{body} {body}"
    assert parse.page_text("<p>" + "x " * 50 + "</p>") is None and parse.page_text(None) is None and parse.page_text("") is None
    assert len(parse.page_text(f"<article>{'word ' * 100_000}</article>")) == parse.LONGEST_BODY

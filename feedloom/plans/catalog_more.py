"""Further registered queries: worklists, reports, filings and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import aggregates, dedup, facts, filings, joins, selections, upsert, worklists
from ..sources import parse
from . import composites as C
from . import testviews as V
from .catalog import SIGNALS, _query, strip_sql
from .testviews import SQL, as_of


@_query("p1_active_feeds", SQL + "SELECT f.id, company_name, feed_type FROM feeds f JOIN symbols s ON s.id = f.symbol_id WHERE is_active AND exchange = 3 AND feed_type IN ('rss', 'atom')")
def _(s, d):
    return selections.active_feeds(V.feeds(s, d), V.symbols(s, d), 3, ["rss", "atom"]).select("id", "company_name", "feed_type")


@_query("p5_unscored", SQL + "SELECT id FROM articles WHERE score IS NULL")
def _(s, d):
    return selections.unscored(V.articles(s, d)).select("id")


@_query("p8_relevance_gate", SQL + "SELECT id, CASE source_name WHEN 'view' THEN true WHEN 'click' THEN true ELSE false END AS relevant FROM articles")
def _(s, d):
    flag = F.when(F.col("source_name") == "click", " YES ").when(F.col("source_name") != "view", "no")
    return V.articles(s, d).select("id", scoring.relevant(flag).alias("relevant"))


@_query("p11_with_fallback", SQL + ", p AS (SELECT id, symbol_id FROM articles WHERE source_name = 'error'), f AS (SELECT id, symbol_id FROM articles QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id DESC) <= 5) SELECT * FROM p UNION ALL SELECT * FROM f WHERE symbol_id NOT IN (SELECT symbol_id FROM p)")
def _(s, d):
    a = V.articles(s, d)
    newest = dedup.newest_n(a, "symbol_id", 5, [F.desc("published_at"), F.desc("id")])
    return joins.with_fallback(a.filter("source_name = 'error'").select("id", "symbol_id"), newest.select("id", "symbol_id"), "symbol_id")


@_query("p12_nonblank_title", SQL + "SELECT doc_id FROM docs WHERE title IS NOT NULL AND trim(title) <> ''")
def _(s, d):
    return selections.nonblank_title(V.documents(s, d)).select("doc_id")


@_query("p13_active_registry", SQL + "SELECT id, form_type, CASE form_type WHEN '4' THEN 1.2 WHEN 'SC 13D' THEN 1.5 WHEN 'SC 13G/A' THEN 1.3 WHEN '10-K' THEN 2.5 WHEN '10-K/A' THEN 2.5 WHEN '8-K' THEN 1.5 END::DOUBLE AS weight FROM filings WHERE form_type IN ('4', 'SC 13D', 'SC 13G/A', '10-K', '10-K/A', '8-K')")
def _(s, d):
    registry = filings.active_registry([1, 3], ["4", "SC 13D", "SC 13G/A", "10-K", "10-K/A", "8-K", "S-3"])
    return V.filings(s, d).withColumn("weight", filings.of_form(registry, "weight")).filter("weight IS NOT NULL").select("id", "form_type", "weight")


@_query("p14_publisher_allow_list", SQL + "SELECT doc_id FROM docs WHERE source IN ('src1', 'src2', 'src3')")
def _(s, d):
    return selections.publisher_allow_list(V.documents(s, d), ["src1", "src2", "src3"], "source").select("doc_id")


@_query("p15_presence_flags", SQL + "SELECT id, score IS NOT NULL AS has_score, form_type IS NOT NULL AS has_form FROM articles")
def _(s, d):
    return selections.presence_flags(V.articles(s, d), {"has_score": "score", "has_form": "form_type"}).select("id", "has_score", "has_form")


@_query("p16_live_exchange", SQL + "SELECT id, 'EX' || exchange || ':T' || id AS ticker FROM symbols WHERE exchange = 3")
def _(s, d):
    listed = V.symbols(s, d).select("id", F.concat(F.lit("EX"), "exchange", F.lit(":T"), "id").alias("ticker"))
    return selections.live_exchange(listed, "EX3")


@_query("p18_new_industries", SQL + "SELECT count(*) AS new_industries FROM macro WHERE multiplier <= 1.025")
def _(s, d):
    return selections.new_industries(V.macro(s, d).withColumn("last_llm_run_at", F.when(F.col("multiplier") > 1.025, as_of())))


TIMELINES = """, t AS (
  SELECT symbol_id, CASE WHEN form_type IN ('8-K', '8-K/A') THEN 'event' WHEN form_type IN ('S-3', '424B5') THEN 'dilution' WHEN form_type LIKE 'NT%' THEN 'late_notice' END AS kind, published_at::DATE AS day, form_type, coalesce(score, 0) AS amount,
    NULL::DOUBLE AS modifier, left(title, 80) AS title, CASE WHEN form_type IN ('8-K', '8-K/A') THEN left(article_summary, 120) END AS summary FROM filings
  UNION ALL SELECT symbol_id, signal_type, filed_at::DATE, '4', signal_value, modifier, NULL, NULL FROM signals WHERE signal_type IN ('insider_buy', 'insider_sell'))
SELECT symbol_id, kind, day, form_type, amount, modifier, title, summary FROM t WHERE kind IS NOT NULL"""


@_query("p19_event_timelines", SQL + SIGNALS + TIMELINES)
def _(s, d):
    f = V.filings(s, d)
    return selections.event_timelines(f, filings.filing_signals(f))


@_query("p20_pending_research", SQL + "SELECT id, published_at FROM articles WHERE source_name <> 'view' ORDER BY published_at DESC, id LIMIT 50")
def _(s, d):
    return selections.pending_research(V.articles(s, d).withColumn("llm_processed", F.col("source_name") == "view"), 50).select("id", "published_at")


@_query("p21_filing_detail", SQL + "SELECT f.id, f.form_type, f.title FROM filings f JOIN symbols s ON s.id = f.symbol_id AND s.status WHERE company_name = 'Customer#000000004' ORDER BY published_at DESC, f.id DESC LIMIT 50")
def _(s, d):
    return selections.filing_detail(V.symbols(s, d), V.filings(s, d), "Customer#000000004").select("id", "form_type", "title")


@_query("j2_articles_with_feed", SQL + "SELECT a.id, feed_url, feed_type FROM stories a LEFT JOIN feeds f ON f.id = a.feed_id AND f.is_active")
def _(s, d):
    return joins.articles_with_feed(V.stories(s, d), V.feeds(s, d).filter("is_active")).select("id", "feed_url", "feed_type")


@_query("j2_orders_with_customer", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def _(s, d):
    rich = V.table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("feed_url"), F.lit("").alias("feed_type"))
    return joins.articles_with_feed(V.table(s, d, "orders").withColumnRenamed("o_custkey", "feed_id"), rich).select("o_orderkey", F.col("feed_url").alias("c_name"))


@_query("j10_symbol_nation", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    nation = V.table(s, d, "nation").join(V.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    catalog = nation.select(F.col("n_nationkey").alias("sector_id"), F.col("n_name").alias("sector_name"), F.col("r_name").alias("industry_name"), F.lit(1.0).alias("multiplier"))
    own = V.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("sector_id"))
    return joins.symbol_sector(own, catalog).select("c_custkey", F.col("sector_name").alias("n_name"), F.col("industry_name").alias("r_name"))


@_query("j13_resolve_tickers", SQL + "SELECT event_id, id AS symbol_id FROM events JOIN symbols ON id = user_id AND status")
def _(s, d):
    known = V.symbols(s, d).withColumn("ticker_name", F.concat(F.lit("t"), F.col("id")))
    return joins.resolve(V.table(s, d, "events").select("event_id", F.concat(F.lit("T"), F.col("user_id")).alias("ticker")), known, "ticker", "ticker_name").select("event_id", "symbol_id")


@_query("j14_form_assignment", SQL + "SELECT id, form FROM symbols, (VALUES ('10-K'), ('10-K/A'), ('10-Q'), ('10-Q/A')) f(form) WHERE status UNION ALL SELECT id, form FROM symbols, (VALUES ('8-K'), ('8-K/A')) f(form) WHERE status AND id NOT IN (SELECT symbol_id FROM feeds WHERE is_active AND feed_type = 'atom')")
def _(s, d):
    return joins.form_assignment(V.symbols(s, d), filings.active_registry([1]), V.feeds(s, d).filter("is_active AND feed_type = 'atom'"))


@_query("j18_related_research", """WITH sym AS (SELECT DISTINCT p_partkey AS symbol_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS sector FROM part),
kw AS (SELECT DISTINCT s.sector, c.p_name AS keyword FROM (SELECT DISTINCT sector FROM sym WHERE length(sector) > 2) s JOIN part c ON contains(lower(c.p_type), lower(s.sector)) UNION SELECT sector, sector FROM sym WHERE length(sector) > 2),
res AS (SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS published_at, split_part(text, chr(10), 1) || ' ' || (SELECT arg_min(p_name, p_partkey) FROM part WHERE p_partkey = doc_id % 50) || chr(10) || left(text, 300) AS body FROM documents WHERE lang <> 'fr'),
hit AS (SELECT DISTINCT sector, id, published_at FROM res JOIN kw ON contains(lower(body), lower(keyword)) AND regexp_matches(body, '(?i)\\b' || keyword || '\\b')),
top AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY sector ORDER BY published_at DESC, id DESC) <= 8)
SELECT symbol_id, id, published_at FROM sym JOIN top USING (sector) UNION ALL SELECT symbol_id, id, published_at FROM sym, (SELECT id, published_at FROM res ORDER BY published_at DESC, id DESC LIMIT 5) WHERE sector IS NULL""")
def _(s, d):
    part = V.table(s, d, "part")
    symbols = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("sector"))
    names = part.select((F.col("p_partkey")).alias("k"), "p_name")
    told = V.stories(s, d).withColumn("k", F.col("id") % 50).join(names, "k").withColumns({"title": F.concat("title", F.lit(" "), "p_name"), "llm_processed": F.col("lang") != "fr"})
    return joins.related_research(symbols, part.select(F.col("p_type").alias("sector_name"), F.col("p_name").alias("industry_name")), told)


@_query("j18_related_documents", SQL + "SELECT p_brand, doc_id FROM (SELECT DISTINCT p_brand, 'src' || (p_size % 20) AS source FROM part) JOIN docs USING (source) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n_chars DESC, doc_id) <= 8")
def _(s, d):
    topics = V.table(s, d, "part").select("p_brand", F.concat(F.lit("src"), F.col("p_size") % 20).alias("source")).distinct()
    newest = dedup.newest_n(V.documents(s, d).select("doc_id", "source", "n_chars"), "source", 8, [F.desc("n_chars"), F.col("doc_id")])
    # eight per source suffice: no brand takes more than eight from one source
    return dedup.newest_n(topics.join(newest, "source"), "p_brand", 8, [F.desc("n_chars"), F.col("doc_id")]).select("p_brand", "doc_id")


@_query("j19_in_flight", SQL + "SELECT q.id, company_name, o.at AS started_at, date_diff('microsecond', o.at, TIMESTAMP '2024-03-15') / 1e6 AS elapsed, (SELECT count(*) FROM articles a WHERE a.symbol_id = q.id AND score IS NULL) AS unscored FROM queue q JOIN symbols s ON s.id = q.id JOIN (SELECT symbol_id, max(added_at) AS at FROM feeds GROUP BY 1) o ON o.symbol_id = q.id")
def _(s, d):
    started = V.feeds(s, d).groupBy("symbol_id").agg(F.max("added_at").alias("started_at")).join(V.queue(s, d).select(F.col("id").alias("symbol_id")), "symbol_id")
    return joins.in_flight(started, V.symbols(s, d), V.articles(s, d), as_of())


@_query("j20_cik_lookup", SQL + "SELECT count(*) AS n, count(*) FILTER (id NOT IN (SELECT id FROM queue)) AS missing FROM symbols")
def _(s, d):
    known = parse.build_cik_map(V.queue(s, d).select(F.concat(F.lit("t"), "id").alias("ticker"), F.col("id").alias("cik")), V.queue(s, d).select(F.concat(F.lit("T"), "id").alias("ticker"), F.lit(0).alias("cik")))
    return joins.lookup_misses(joins.cik_lookup(V.symbols(s, d).withColumn("symbol", F.concat(F.lit("T"), "id")), known), "cik")


@_query("j20_lookup_misses", "SELECT count(*) AS n, count(*) FILTER (p_partkey IS NULL) AS missing FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON p_partkey = l_partkey")
def _(s, d):
    part = V.table(s, d, "part").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("ticker"), F.col("p_partkey").alias("cik"))
    return joins.lookup_misses(joins.cik_lookup(V.table(s, d, "lineitem").withColumn("symbol", F.col("l_partkey").cast("string")), part), "cik")


@_query("a3_feed_counts", SQL + "SELECT symbol_id, count(DISTINCT CASE WHEN is_active THEN id END) AS active, count(DISTINCT id) AS total FROM feeds GROUP BY 1")
def _(s, d):
    return aggregates.feed_counts(V.feeds(s, d))


@_query("a5_source_weighted_mean", SQL + ", u AS (SELECT *, w * CASE WHEN form_type IS NULL THEN 1 ELSE 1.5 END AS v FROM weighted WHERE abs(score) >= 0.25) SELECT symbol_id, round(sum(score * v) / sum(v), 6) AS mean_score FROM u GROUP BY 1")
def _(s, d):
    weight = F.when(F.col("form_type").isNull(), 1.0).otherwise(1.5)
    return aggregates.source_weighted_mean(V.articles(s, d), "symbol_id", "score", "published_at", weight, as_of()).select("symbol_id", F.round("mean_score", 6).alias("mean_score"))


@_query("a6_legacy_mean", SQL + "SELECT symbol_id, round(avg(score * w), 6) AS mean_score FROM weighted GROUP BY 1")
def _(s, d):
    return aggregates.legacy_mean(V.articles(s, d), "symbol_id", "score", "published_at", as_of()).withColumn("mean_score", F.round("mean_score", 6))


@_query("a8_newest_material", SQL + "SELECT symbol_id, max(CASE WHEN abs(score) >= 0.25 THEN published_at END) AS newest FROM articles GROUP BY 1")
def _(s, d):
    return aggregates.newest_material(V.articles(s, d), "symbol_id", "score", "published_at")


@_query("a12_feed_article_counts", SQL + "SELECT f.id, count(a.id) AS article_count FROM feeds f LEFT JOIN stories a ON a.feed_id = f.id GROUP BY 1")
def _(s, d):
    return aggregates.feed_article_counts(V.feeds(s, d), V.stories(s, d)).select("id", "article_count")


@_query("a18_connection_sets", "SELECT DISTINCT l_partkey % 50 AS symbol, trim(s_name) AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE trim(s_name) <> ''")
def _(s, d):
    pairs = V.table(s, d, "lineitem").select((F.col("l_partkey") % 50).alias("symbol"), "l_suppkey").distinct()
    named = pairs.join(V.table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("symbol", F.array(F.concat("s_name", F.lit(" ")), F.lit(" ")).alias("names"))
    return aggregates.connection_sets(named, "symbol", "names")


@_query("a20_insider_totals", "SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity * l_extendedprice ELSE 0 END), 2) AS bought, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity * l_extendedprice ELSE 0 END), 2) AS sold, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    code = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S")
    totals = aggregates.insider_totals(V.table(s, d, "lineitem").withColumn("code", code), "l_suppkey", shares="l_quantity", price="l_extendedprice")
    return totals.withColumns({"bought": F.round("bought", 2), "sold": F.round("sold", 2)})


@_query("a22_run_summary", SQL + "SELECT coalesce(form_type, 'total') AS form, count(*) AS n FROM articles WHERE form_type IS NOT NULL GROUP BY ROLLUP (form_type)")
def _(s, d):
    return aggregates.run_summary(V.articles(s, d))


@_query("a23_max_multiplier_per_sector", SQL + "SELECT sector_name, max(multiplier) AS multiplier FROM macro GROUP BY 1")
def _(s, d):
    return aggregates.max_multiplier_per_sector(V.macro(s, d))


@_query("a24_ordered_ids", SQL + "SELECT symbol_id, id, row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id) AS place, row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id) = 1 AS keeper FROM articles")
def _(s, d):
    return aggregates.ordered_ids(V.articles(s, d), "symbol_id", "published_at")


@_query("w6_last_n_by_family", SQL + "SELECT id, symbol_id, form_type FROM articles WHERE form_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id, form_type ORDER BY published_at DESC, id DESC) <= 5")
def _(s, d):
    return dedup.last_n_by_family(V.articles(s, d).filter("form_type IS NOT NULL")).select("id", "symbol_id", "form_type")


@_query("t3_worklist", SQL + """, a AS (SELECT symbol_id AS id, max(hours) AS elapsed FROM aged WHERE form_type = '10-K' GROUP BY 1), t AS (SELECT s.id, CASE WHEN a.id IS NOT NULL THEN 0 WHEN q.id IS NOT NULL THEN 1 ELSE 2 END AS tier, md5(s.id || '|2024-03-15') AS k FROM symbols s LEFT JOIN a ON a.id = s.id LEFT JOIN queue q ON q.id = s.id)
    SELECT id, tier FROM t WHERE tier < 2 UNION ALL (SELECT id, tier FROM t WHERE tier = 2 ORDER BY k, id LIMIT 50)""")
def _(s, d):
    active = V.articles(s, d).filter("form_type = '10-K'").groupBy(F.col("symbol_id").alias("id")).agg(F.max(scoring.age_hours("published_at", as_of())).alias("elapsed"))
    return worklists.worklist(V.symbols(s, d), active, V.queue(s, d), as_of()).select("id", "tier")


@_query("t4_daily_shuffle", SQL + "SELECT id, md5(id || '|2024-03-15') AS shuffle_key FROM symbols")
def _(s, d):
    return worklists.daily_shuffle(V.symbols(s, d), as_of()).select("id", "shuffle_key")


@_query("t8_capped_worklist", SQL + "SELECT s.id, rank FROM symbols s LEFT JOIN queue q ON q.id = s.id ORDER BY rank NULLS LAST, md5(s.id || '|2024-03-15'), s.id LIMIT 60")
def _(s, d):
    return worklists.capped_worklist(V.symbols(s, d), V.queue(s, d), 60, as_of()).select("id", "rank")


@_query("t9_unscored_first", SQL + "SELECT id FROM articles ORDER BY score IS NOT NULL, published_at DESC, id LIMIT 200")
def _(s, d):
    return worklists.symbol_articles(V.articles(s, d)).select("id")


@_query("u4_distinct_union", "SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier")
def _(s, d):
    return joins.distinct_union(V.table(s, d, "part").select(F.col("p_name").alias("name")), V.table(s, d, "supplier").select("s_name"))


@_query("f2_time_decay", SQL + "SELECT id, round(score * w, 6) AS decayed FROM weighted")
def _(s, d):
    return V.articles(s, d).select("id", scoring.time_decay("score", "published_at", as_of()).alias("decayed"))


@_query("f5_growth_multiplier", "SELECT p_partkey, round(CASE WHEN p_size / 50.0 <= 0.4 THEN 1.0 ELSE 1 + (least(1.0, p_size / 50.0) - 0.4) / 0.6 * 0.05 END, 3)::DOUBLE AS multiplier FROM part")
def _(s, d):
    return V.table(s, d, "part").select("p_partkey", scoring.growth_to_multiplier(F.col("p_size") / 50.0).alias("multiplier"))


@_query("f7_final_article_score", SQL + "SELECT id, CASE WHEN source_name = 'error' THEN 0.0 WHEN score >= 1 THEN 1.0 ELSE greatest(-1.0, CASE WHEN least(0.999, score + 0.02) > 0 THEN least(least(0.999, score + 0.02), 0.969) ELSE least(0.999, score + 0.02) END) END AS final FROM articles WHERE score IS NOT NULL")
def _(s, d):
    flag = F.when(F.col("source_name") == "error", "false")
    final = scoring.final_article_score("score", F.lit(0.02), F.lit("STRONG band"), flag)
    return V.articles(s, d).filter("score IS NOT NULL").select("id", final.alias("final"))


@_query("f11_classify_url", "WITH p AS (SELECT page_id, lower(url) AS u, regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(lower(url), '\\?([^#]*)', 1) AS q FROM (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '/atom/x' WHEN 1 THEN '/rss' WHEN 2 THEN '.xml' WHEN 3 THEN '?type=atom' WHEN 4 THEN '?format=feed' ELSE '' END AS url FROM pages)) SELECT page_id, CASE WHEN contains(path, 'atom') OR contains(q, 'type=atom') OR contains(q, 'format=atom') THEN 'atom' WHEN regexp_matches(u, '/rss|/atom|/feed|(rss|atom|feed|news)\\.xml|rss/news|rss/press|atom/news') OR regexp_matches(q, 'pagetemplate=rss|format=(rss|feed)|type=(atom|rss)|feed=(rss|atom)|output=rss') OR u LIKE '%.xml' THEN 'rss' END AS kind FROM p")
def _(s, d):
    k = F.col("page_id") % 6
    url = F.concat("url", F.when(k == 0, "/atom/x").when(k == 1, "/rss").when(k == 2, ".xml").when(k == 3, "?type=atom").when(k == 4, "?format=feed").otherwise(""))
    return V.table(s, d, "pages").select("page_id", text.classify_feed_url(url).alias("kind"))


@_query("f21_longest_body", "WITH x AS (SELECT page_id, " + strip_sql("html") + " AS a, " + strip_sql("url") + " AS b FROM pages) SELECT page_id, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS body, nullif(CASE WHEN length(a) >= length(b) THEN b ELSE a END, '') AS other FROM x")
def _(s, d):
    return V.table(s, d, "pages").withColumn("x", facts.longest_body("html", "url")).select("page_id", F.col("x.body").alias("body"), F.col("x.other").alias("other"))


@_query("f22_scoring_payload", SQL + "SELECT doc_id, length(title) > 0 AS ok FROM docs")
def _(s, d):
    parsed = F.from_json(facts.scoring_payload("doc_id", "title"), "doc_id long, title string")
    return V.documents(s, d).withColumn("p", parsed).select("doc_id", (F.length("p.title") > 0).alias("ok"))


@_query("f29_score_boost", SQL + "SELECT sector_name, industry_name, round((multiplier - 1) * 100, 6) AS boost, round(0.5 / (multiplier * 1.01), 6) AS base FROM macro")
def _(s, d):
    m = scoring.score_decomposition(V.macro(s, d).withColumns({"final_score": F.lit(0.5), "ai_multiplier": F.lit(1.01)}), macro="multiplier")
    return m.select("sector_name", "industry_name", F.round("macro_boost", 6).alias("boost"), F.col("base_score").alias("base"))


@_query("q6_sync_universe", SQL + "SELECT CASE WHEN t.id IS NULL THEN 'new' WHEN l.id IS NULL AND t.status THEN 'delisted' WHEN l.id IS NULL THEN 'unchanged' WHEN NOT t.status THEN 'restored' ELSE 'unchanged' END AS action, count(*) AS n FROM (SELECT * FROM symbols WHERE sector <> 'FURNITURE') l FULL JOIN (SELECT * FROM symbols WHERE exchange <> 3) t ON l.id = t.id GROUP BY 1")
def _(s, d):
    v = V.symbols(s, d).withColumn("symbol", F.concat(F.lit("T"), "id"))
    live = v.filter("sector <> 'FURNITURE'").select(F.concat(F.lit("NYSE:"), "symbol").alias("ticker"), "company_name")
    return C.sync_universe(live, v.filter("exchange <> 3"), "NYSE", as_of())["actions"].groupBy("action").agg(F.count("*").alias("n"))


@_query("q7_research_multipliers", "SELECT p_type AS sector_name, p_name AS industry_name, greatest(1.0, max(round(CASE WHEN p_size / 50.0 <= 0.4 THEN 1.0 ELSE 1 + (least(1.0, p_size / 50.0) - 0.4) / 0.6 * 0.05 END, 3)))::DOUBLE AS multiplier FROM part GROUP BY 1, 2")
def _(s, d):
    p = V.table(s, d, "part").select(F.col("p_type").alias("sector_name"), F.col("p_name").alias("industry_name"), (F.col("p_size") / 50.0).alias("growth"), F.col("p_partkey").alias("article_id"), F.col("p_brand").alias("rationale"), F.col("p_partkey").alias("seq"))
    catalog = p.select("sector_name", "industry_name").distinct().withColumns({"multiplier": F.lit(1.0), "rationale": F.lit("")})
    done = V.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit(False).alias("llm_processed"))
    return C.research_multipliers(p, catalog, done)["catalog"].select("sector_name", "industry_name", "multiplier")


DASHBOARD = ", nn AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id DESC) <= 200)"


def dashboard(s, d, part: str):
    f = V.filings(s, d)
    return C.filing_dashboard(f, filings.filing_signals(f), f, as_of())[part]


@_query("q8_filing_dashboard", SQL + DASHBOARD + """ SELECT symbol_id, 0::BIGINT AS n_news, count(*) FILTER (form_type LIKE '10-K%') AS n_10k, count(*) FILTER (form_type LIKE '10-Q%') AS n_10q, count(*) FILTER (form_type LIKE '8-K%') AS n_8k, count(*) FILTER (form_type = '4') AS n_4,
    count(*) FILTER (form_type LIKE 'SC 13D%') AS n_13d, count(*) FILTER (form_type LIKE 'SC 13G%') AS n_13g, count(*) FILTER (form_type IN ('S-3', '424B5')) AS n_s3, count(*) FILTER (form_type LIKE 'NT%') AS n_nt, 0::BIGINT AS n_other FROM nn GROUP BY 1""")
def _(s, d):
    return dashboard(s, d, "counts")


@_query("q8_annual", SQL + DASHBOARD + " SELECT id, symbol_id, year(published_at)::VARCHAR AS label, revenue::DOUBLE AS revenue, cash_flow::DOUBLE AS operating_cash_flow FROM nn WHERE form_type LIKE '10-K%' QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id DESC) <= 5")
def _(s, d):
    return dashboard(s, d, "annual").select("id", "symbol_id", "label", "revenue", "operating_cash_flow")


@_query("q8_quarterly", SQL + DASHBOARD + " SELECT id, 'Q' || quarter(published_at) || ' ' || year(published_at) AS label, revenue::DOUBLE AS revenue, cash_flow - 2000.0 AS burn FROM nn WHERE form_type = '10-Q' QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id DESC) <= 5")
def _(s, d):
    return dashboard(s, d, "quarterly").select("id", "label", "revenue", "burn")


@_query("q8_events", SQL + SIGNALS + TIMELINES.replace("FROM filings", "FROM (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id DESC) <= 200)").replace("FROM signals", "FROM (SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY filed_at DESC, id DESC, signal_type) <= 100)"))
def _(s, d):
    return dashboard(s, d, "events")


@_query("q8_coverage", SQL + DASHBOARD + " SELECT symbol_id, form_type, floor(date_diff('microsecond', published_at, TIMESTAMP '2024-03-15') / 1e6 / 86400 / 30)::BIGINT AS months, count(*) AS n FROM nn GROUP BY ALL")
def _(s, d):
    return dashboard(s, d, "coverage")


@_query("q9_symbol_report", SQL + """, r AS (SELECT * FROM articles WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id DESC) <= 50), k AS (SELECT s.id, coalesce(max(m.multiplier), 1.0) AS k FROM symbols s LEFT JOIN macro m ON s.industry <> '' AND contains(lower(m.industry_name), lower(s.industry)) GROUP BY 1),
    o AS (SELECT o_custkey, max(o_orderdate) AS at FROM orders GROUP BY 1)
    SELECT r.id, company_name, round(abs(score) / greatest(1e-9, sum(abs(score)) OVER (PARTITION BY symbol_id)) * 100, 6) AS share, round(0.5 / (k * 1.0), 6) AS base_score, o.at AS snapshot_date FROM r JOIN symbols s ON s.id = r.symbol_id JOIN k ON k.id = s.id LEFT JOIN o ON o_custkey = s.id""")
def _(s, d):
    return _report(s, d)["articles"].select("id", "company_name", F.round("share", 6).alias("share"), "base_score", "snapshot_date")


def _report(s, d):
    own = V.symbols(s, d).withColumns({"final_score": F.lit(0.5), "ai_multiplier": F.lit(1.0)})
    snapshots = V.table(s, d, "orders").groupBy(F.col("o_custkey").alias("symbol_id"), F.col("o_orderdate").alias("snapshot_date")).agg(F.max("o_orderpriority").alias("data"))
    told = V.stories(s, d).select("id", "published_at", F.concat(F.when(F.col("id") % 7 == 0, "About building, "), "title").alias("title"), "summary", (F.col("lang") != "fr").alias("llm_processed"))
    names = V.table(s, d, "orders").select(F.col("o_custkey").alias("symbol_id"), F.col("o_orderstatus").alias("relation"), F.concat(F.lit(" "), F.left("o_orderpriority", F.lit(4))).alias("names"))
    return C.symbol_report(own, V.articles(s, d), V.macro(s, d).withColumn("rationale", F.lit("r")), snapshots, research=told, connections=names)


@_query("q9_connections", "SELECT DISTINCT o_custkey AS symbol_id, o_orderstatus AS relation, trim(left(o_orderpriority, 4)) AS name FROM orders")
def _(s, d):
    return _report(s, d)["connections"]


@_query("q9_related", SQL + """, r AS (SELECT id, published_at, CASE WHEN id % 7 = 0 THEN 'About building, ' ELSE '' END || title || chr(10) || summary AS body FROM stories WHERE lang <> 'fr'),
    hit AS (SELECT sector, r.id, published_at FROM (SELECT DISTINCT sector FROM symbols WHERE length(sector) > 2) JOIN r ON contains(lower(body), lower(sector)) AND regexp_matches(body, '(?i)\\b' || sector || '\\b') QUALIFY row_number() OVER (PARTITION BY sector ORDER BY published_at DESC, r.id DESC) <= 8)
    SELECT s.id AS symbol_id, hit.id, published_at FROM symbols s JOIN hit USING (sector)""")
def _(s, d):
    return _report(s, d)["related"]


@_query("q10_dedup_all", SQL + """, u AS (SELECT * FROM stories QUALIFY row_number() OVER (PARTITION BY symbol_id, url ORDER BY id) = 1), t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY symbol_id, lower(trim(coalesce(title, ''))) ORDER BY score IS NULL, published_at DESC, id) = 1),
    v AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol_id, time_bucket(INTERVAL 5 MINUTES, published_at), source_name ORDER BY score IS NULL, NOT contains(url, '/0/en/'), coalesce(score, -99) DESC, id) = 1)
    SELECT 'before' AS step, count(*) AS n FROM stories UNION ALL SELECT 'urls', count(*) FROM u UNION ALL SELECT 'titles', count(*) FROM t UNION ALL SELECT 'variants', count(*) FROM v""")
def _(s, d):
    return C.dedup_all(V.stories(s, d))[1].select("step", "n")


@_query("q10_kept", SQL + ", g AS (SELECT *, symbol_id % 3 AS g FROM stories), u AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY g, url ORDER BY id) = 1) SELECT id FROM u QUALIFY row_number() OVER (PARTITION BY g, lower(trim(coalesce(title, ''))) ORDER BY score IS NULL, published_at DESC, id) = 1")
def _(s, d):
    return C.dedup_all(V.stories(s, d).withColumn("symbol_id", F.col("symbol_id") % 3))[0].select("id")


@_query("q11_data_health", SQL + """ SELECT 'feeds without articles' AS report, feed_type AS item, count(*) AS n FROM feeds WHERE id NOT IN (SELECT feed_id FROM stories) GROUP BY 2
    UNION ALL (SELECT 'hosts without articles', regexp_extract(feed_url, '^[A-Za-z]+://([^/?#]+)', 1), count(*) AS n FROM feeds WHERE id NOT IN (SELECT feed_id FROM stories) GROUP BY 2 ORDER BY n DESC, 2 LIMIT 20)
    UNION ALL SELECT 'articles by source', source_name, count(*) FROM stories GROUP BY 2 UNION ALL SELECT 'symbols without feed', NULL, count(*) FROM symbols WHERE id NOT IN (SELECT symbol_id FROM feeds WHERE is_active)
    UNION ALL SELECT 'repeated titles', NULL, count(*) FROM (SELECT 1 FROM stories GROUP BY symbol_id, lower(trim(title)) HAVING count(*) > 1)""")
def _(s, d):
    return C.data_health(V.symbols(s, d), V.feeds(s, d), V.stories(s, d))


@_query("q3_ingest_articles", SQL + """, a AS (SELECT doc_id, text, lang, title, sha256('https://n.example/' || sha256(text) || '|' || title || '|' || '2024-01-01T00:00:00') AS h, 'https://n.example/' || sha256(text) AS url FROM docs)
    SELECT h AS article_hash, title, url, true AS was_stored FROM a WHERE lang = 'fr' GROUP BY ALL UNION ALL SELECT h, title, url, false FROM a WHERE trim(title) <> '' AND h NOT IN (SELECT h FROM a WHERE lang = 'fr') GROUP BY ALL""")
def _(s, d):
    raw = V.documents(s, d).select(
        "title", F.concat(F.lit("https://n.example/"), F.sha2("text", 256)).alias("url"), F.lit("2024-01-01").cast("timestamp").alias("published_at"), F.lit("").alias("summary"),
        F.concat(F.lit("<article>"), "text", F.lit("</article>")).alias("html"), "lang", F.lit(False).alias("was_stored"),
    )
    hashed = raw.filter("lang = 'fr'").withColumns({"article_hash": text.article_hash("url", "title", "published_at"), "full_text": F.lit(""), "was_stored": F.lit(True)})
    stored = hashed.select("article_hash", "title", "url", "full_text", "was_stored").distinct()
    return C.ingest_articles(raw, stored).select("article_hash", "title", "url", "was_stored")


@_query("q3_ingest_new_documents", SQL + "SELECT sha256(text) AS article_hash, min(doc_id) AS doc_id FROM docs WHERE trim(title) <> '' AND sha256(text) NOT IN (SELECT sha256(text) FROM docs WHERE lang = 'fr') GROUP BY 1")
def _(s, d):
    docs = V.documents(s, d).withColumn("article_hash", F.sha2("text", 256))
    fresh = dedup.keep_first(selections.nonblank_title(docs), ["article_hash"], [F.col("doc_id")])
    return fresh.join(docs.filter("lang = 'fr'").select("article_hash"), "article_hash", "left_anti").select("article_hash", "doc_id")


@_query("k11_touch_checked", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN TIMESTAMP '2024-03-15' END AS checked_at FROM customer")
def _(s, d):
    feeds = V.table(s, d, "customer").select("c_custkey", F.lit(None).cast("timestamp").alias("checked_at"))
    return upsert.touch_checked(feeds, V.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "checked_at", as_of())


@_query("k8_mark_processed", SQL + "SELECT id, source_name = 'error' OR coalesce(score > 0.5, false) AS done FROM articles")
def _(s, d):
    a = V.articles(s, d)
    return upsert.mark_processed(a.select("id", F.coalesce(F.col("score") > 0.5, F.lit(False)).alias("done")), a.filter("source_name = 'error'"), "id", "done")

"""The registered queries of the library and their SQL.

Names start with the operator's number in the survey. Each query applies one
operator of the library to the driver's tables by way of ``testviews``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import aggregates, dedup, facts, joins, selections, upsert, worklists
from . import composites as C
from . import testviews as V
from .testviews import SQL, as_of

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return add


def queries() -> dict:
    from . import catalog_landed, catalog_more  # noqa: F401  these register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def exact_mean_sql(value: str, places: int) -> str:
    """The mean of values of six decimals, half up, as ``aggregates.exact_mean`` gives it."""
    micros, unit = f"(sum(({value})::DECIMAL(18,6)) * 1000000)::BIGINT", 10 ** (6 - places)
    return f"CASE WHEN count({value}) > 0 THEN (CASE WHEN {micros} < 0 THEN -1.0 ELSE 1.0 END) * ((2 * abs({micros}) + {unit} * count({value})) // ({2 * unit} * count({value})))::DOUBLE / {float(10**places)} END"


def title_sql(body: str, fallback: str) -> str:
    """The title of a filing, as ``facts.filing_title`` finds it."""
    lines = f"list_filter(list_transform(string_split({body}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
    good = "length(x) BETWEEN 20 AND 250 AND NOT regexp_matches(x, '(?i)securities and exchange|washington|form \\d|united states|commission file') AND regexp_matches(x, '[a-z]')"
    return f"coalesce(left(list_filter(({lines})[6:], lambda x: {good})[1], 200), {fallback})"


def strip_sql(html: str) -> str:
    """``text.strip_html`` of a column."""
    out = f"regexp_replace({html}, '<[^>]*>', ' ', 'g')"
    for entity, char in text.ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


#: Signals of the filings view.
SIGNALS = """, signals AS (
  SELECT id, symbol_id, published_at AS filed_at, CASE form_type WHEN 'NT 10-K' THEN 'late_annual' WHEN 'NT 10-Q' THEN 'late_quarterly' WHEN 'SC 13D' THEN 'stake' WHEN 'SC 13G/A' THEN 'passive_stake_change' WHEN 'S-3' THEN 'shelf' ELSE 'offering' END AS signal_type,
    NULL::DOUBLE AS signal_value, CASE form_type WHEN 'NT 10-K' THEN -0.05 WHEN 'NT 10-Q' THEN -0.03 WHEN 'SC 13D' THEN 0.05 WHEN 'SC 13G/A' THEN 0.01 WHEN 'S-3' THEN -0.02 ELSE -0.04 END::DOUBLE AS modifier
  FROM filings WHERE form_type IN ('NT 10-K', 'NT 10-Q', 'SC 13D', 'SC 13G/A', 'S-3', '424B5')
  UNION ALL SELECT id, symbol_id, published_at, 'insider_buy', bought, least(0.03, greatest(0.01, bought / 1e6 * 0.01)) FROM filings WHERE form_type = '4' AND bought > 0
  UNION ALL SELECT id, symbol_id, published_at, 'insider_sell', sold, -0.01 FROM filings WHERE form_type = '4' AND sold > 0)
"""

#: Means, multipliers, the asymptote and the pull; ``{weight}`` is an article's and ``{rows}`` are the articles.
_FINAL = """, means AS (
  SELECT symbol_id, sum(score * w * {weight}) / sum(w * {weight}) AS m, max(published_at) AS newest, count(*) AS n
  FROM (SELECT *, exp(-0.0007 * greatest(0, date_diff('microsecond', published_at, TIMESTAMP '2024-03-15') / 3.6e9 - 24 * 30.44)) AS w FROM {rows})
  WHERE abs(score) >= 0.25 GROUP BY 1),
rated AS (
  SELECT s.id, s.ai_multiplier, coalesce(max(m.multiplier), 1.0) AS macro_multiplier
  FROM rated_symbols s LEFT JOIN macro m ON s.industry <> '' AND contains(lower(m.industry_name), lower(s.industry)) WHERE s.status GROUP BY 1, 2),
raised AS (
  SELECT symbol_id, n, macro_multiplier, coalesce(ai_multiplier, 1.0) AS ai_multiplier, newest, macro_multiplier * coalesce(ai_multiplier, 1.0) AS k,
    CASE WHEN abs(m) <= 0.85 THEN greatest(-1.0, least(1.0, m * k)) ELSE sign(m) * greatest(abs(m), least(1.0, 1 - (1 - abs(m)) * (2 - greatest(0.5, least(2.0, k))))) END AS r
  FROM means JOIN rated ON id = symbol_id),
final AS (
  SELECT *, date_diff('microsecond', newest, TIMESTAMP '2024-03-15') / 3.6e9 - 24 * 14 AS over,
    CASE WHEN r = 0 OR over <= 0 THEN r ELSE round(r * exp(-0.0005 * over), 6) END AS g FROM raised)
"""


@_query("q1_final_scores", SQL + _FINAL.format(weight="1.0", rows="articles") + "SELECT symbol_id, n AS n_material, macro_multiplier, ai_multiplier, round(greatest(-1.0, least(1.0, g)), 6) AS final_score FROM final")
def _(s, d):
    return C.final_scores(V.rated_symbols(s, d), V.articles(s, d), V.macro(s, d), as_of())


#: Weights of forms as the registry of the survey lists them.
_WEIGHT = """CASE WHEN form_type IN ('10-K', '10-K/A') THEN 2.5 WHEN form_type IN ('10-Q', '10-Q/A') THEN 2.0 WHEN form_type IN ('8-K', '8-K/A', 'SC 13D', 'SC 13D/A') THEN 1.5
  WHEN form_type IN ('S-3', 'S-3/A') OR form_type LIKE '424B%' THEN 1.8 WHEN form_type LIKE 'NT 10-%' THEN 1.6 WHEN form_type IN ('SC 13G', 'SC 13G/A') THEN 1.3 WHEN form_type = '4' THEN 1.2 ELSE 1.0 END"""


@_query(
    "q2_final_scores_with_signals",
    SQL + _FINAL.format(weight=f"({_WEIGHT})", rows="mixed") + SIGNALS + """, extra AS (
      SELECT r.id, round(greatest(-0.2, least(0.2, coalesce(sum(modifier::DECIMAL(18,6)), 0)::DOUBLE - CASE WHEN last_10k_filed IS NULL OR last_10k_filed < TIMESTAMP '2024-03-15' - to_hours(13149) - to_minutes(7) - to_seconds(12) THEN 0.06 ELSE 0 END)), 4) AS sec_modifier
      FROM rated_symbols r LEFT JOIN signals g ON g.symbol_id = r.id AND filed_at > TIMESTAMP '2024-03-15' - INTERVAL 180 DAYS GROUP BY r.id, last_10k_filed),
    guard AS (SELECT symbol_id, count(score) AS t FROM mixed WHERE form_type IN ('10-K', '10-K/A', '10-Q', '10-Q/A') GROUP BY 1)
    SELECT symbol_id, sec_modifier, CASE WHEN coalesce(t, 1) > 0 THEN round(greatest(-1.0, least(1.0, g + sec_modifier)), 6) END AS final_score
    FROM final JOIN extra ON extra.id = symbol_id LEFT JOIN guard USING (symbol_id)""",
)
def _(s, d):
    return C.final_scores_with_signals(V.rated_symbols(s, d), V.mixed(s, d), V.macro(s, d), C.filing_signals(V.filings(s, d)), as_of())


@_query("a1_leaderboard", SQL + ", c AS (SELECT symbol_id, count(score) AS n_scored, count(*) AS n_total, " + exact_mean_sql("score", 6) + " AS avg_score FROM articles GROUP BY 1) SELECT s.id, company_name, coalesce(n_scored, 0) AS n_scored, coalesce(n_total, 0) AS n_total, avg_score, CASE WHEN avg_score >= 0.75 THEN 'STRONG BUY' WHEN avg_score >= 0.6 THEN 'BUY' WHEN avg_score >= 0.4 THEN 'NEUTRAL' WHEN avg_score >= 0.25 THEN 'WEAK SELL' WHEN avg_score IS NOT NULL THEN 'SELL' END AS label FROM symbols s LEFT JOIN c ON c.symbol_id = s.id")
def _(s, d):
    return aggregates.leaderboard(V.symbols(s, d), V.articles(s, d))


@_query("a2_leaderboard_stats", SQL + "SELECT count(*) AS n, " + exact_mean_sql("score", 6) + " AS mean, max(score) AS high, min(score) AS low, count(*) FILTER (score > 0.05) AS bullish, count(*) FILTER (score < -0.05) AS bearish FROM articles")
def _(s, d):
    return aggregates.leaderboard_stats(V.articles(s, d))


@_query("a4_decayed_mean", SQL + "SELECT symbol_id, round(sum(score * w) / sum(w), 6) AS mean_score, max(published_at) AS newest, count(*) AS n_material FROM weighted WHERE abs(score) >= 0.25 GROUP BY 1")
def _(s, d):
    return aggregates.decayed_mean(V.articles(s, d), "symbol_id", "score", "published_at", as_of()).withColumn("mean_score", F.round("mean_score", 6))


@_query("a7_signal_modifier", SQL + SIGNALS + ", late AS (SELECT symbol_id, max(published_at) AS filed FROM filings WHERE form_type = '10-K' AND id % 2 = 0 GROUP BY 1) SELECT id AS symbol_id, round(greatest(-0.2, least(0.2, coalesce(total, 0) - CASE WHEN date_diff('microsecond', filed, TIMESTAMP '2024-03-15') / 86400e6 <= 18 * 30.44 THEN 0 ELSE 0.06 END)), 4) AS sec_modifier FROM symbols LEFT JOIN (SELECT symbol_id, sum(modifier::DECIMAL(18,6))::DOUBLE AS total FROM signals WHERE filed_at > TIMESTAMP '2024-03-15' - INTERVAL 60 DAYS GROUP BY 1) t ON t.symbol_id = id LEFT JOIN late ON late.symbol_id = id")
def _(s, d):
    f = V.filings(s, d)
    annual = f.filter("form_type = '10-K' AND id % 2 = 0").groupBy(F.col("symbol_id").alias("id")).agg(F.max("published_at").alias("last_10k_filed"))
    return aggregates.sec_modifier(C.filing_signals(f), V.symbols(s, d).join(annual, "id", "left"), as_of(), days=60)


@_query("a9_coverage_guard", SQL + "SELECT symbol_id, count(*) AS total, count(score) AS scored, count(score) = 0 AS blocked FROM filings WHERE form_type IN ('10-K', '10-K/A', '10-Q', '10-Q/A') GROUP BY 1")
def _(s, d):
    return aggregates.tier1_coverage_guard(V.filings(s, d))


@_query("a10_duplicate_titles", SQL + "SELECT lower(trim(title)) AS title, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return dedup.duplicate_groups(V.documents(s, d), [F.lower(F.trim("title")).alias("title")])


@_query("a11_unscored_worklist", SQL + "SELECT symbol_id, count(*) AS unscored FROM articles WHERE score IS NULL GROUP BY 1")
def _(s, d):
    return aggregates.unscored_worklist(V.articles(s, d))


@_query("a13_hosts", "SELECT regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 20")
def _(s, d):
    return aggregates.top_hosts(V.table(s, d, "pages"), "url")


@_query("a13_zero_article_domains", SQL + "SELECT regexp_extract(feed_url, '^[A-Za-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM feeds WHERE id NOT IN (SELECT feed_id FROM stories) GROUP BY 1 ORDER BY n DESC, host LIMIT 20")
def _(s, d):
    return aggregates.zero_article_domains(V.feeds(s, d), V.stories(s, d))


@_query("a14_source_profile", SQL + "SELECT source, lang, count(*) AS n, min(n_chars) AS lowest, max(n_chars) AS highest FROM docs GROUP BY 1, 2")
def _(s, d):
    return aggregates.source_profile(V.documents(s, d), ["source", "lang"], "n_chars")


@_query("a15_family_counts", SQL + """, f AS (SELECT symbol_id, form_type AS t FROM filings UNION ALL SELECT symbol_id, NULL FROM articles WHERE form_type IS NULL) SELECT symbol_id, count(*) FILTER (t IS NULL) AS n_news,
    count(*) FILTER (t LIKE '10-K%') AS n_10k, count(*) FILTER (t LIKE '10-Q%') AS n_10q, count(*) FILTER (t IN ('8-K', '8-K/A')) AS n_8k, count(*) FILTER (t = '4') AS n_4, count(*) FILTER (t LIKE 'SC 13D%') AS n_13d,
    count(*) FILTER (t LIKE 'SC 13G%') AS n_13g, count(*) FILTER (t LIKE 'S-3%' OR t LIKE '424B%') AS n_s3, count(*) FILTER (t LIKE 'NT%') AS n_nt, 0::BIGINT AS n_other FROM f GROUP BY 1""")
def _(s, d):
    news = V.articles(s, d).filter("form_type IS NULL").select("symbol_id", "form_type")
    return aggregates.family_counts(V.filings(s, d).select("symbol_id", "form_type").unionByName(news), "symbol_id", "form_type")


@_query("a16_score_composition", SQL + """, r AS (SELECT * FROM (SELECT id, symbol_id, published_at, score, CASE WHEN id % 3 = 0 THEN NULL ELSE form_type END AS form_type FROM filings WHERE score IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id DESC) <= 50)
    SELECT symbol_id, """ + ", ".join(f"coalesce({exact_mean_sql(f'CASE WHEN {c} THEN score END', 4)}, 0) AS {n}" for c, n in (("form_type IS NULL", "news"), ("form_type LIKE '10-K%'", "annual"), ("form_type LIKE '10-Q%'", "quarterly"), ("form_type IN ('8-K', '8-K/A')", "events"))) + " FROM r GROUP BY 1")
def _(s, d):
    return aggregates.score_composition(V.filings(s, d).withColumn("form_type", F.when(F.col("id") % 3 != 0, F.col("form_type"))))


@_query("a17_coverage_heatmap", SQL + "SELECT form_type, floor(date_diff('microsecond', published_at, TIMESTAMP '2024-03-15') / 1e6 / 86400 / 30)::BIGINT AS months, count(*) AS n FROM filings GROUP BY 1, 2")
def _(s, d):
    return aggregates.coverage_heatmap(V.filings(s, d), as_of())


@_query("a19_top_hints", SQL + ", c AS (SELECT symbol_id, source_name, count(*) AS n FROM articles GROUP BY 1, 2) SELECT symbol_id, source_name, n FROM c QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY n DESC, source_name) <= 3")
def _(s, d):
    return aggregates.top_k(V.articles(s, d), "symbol_id", "source_name", 3)


@_query("a21_throughput", SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY published_at DESC, id DESC) AS k FROM articles WHERE published_at > TIMESTAMP '2024-01-25' - INTERVAL 24 HOURS AND published_at <= TIMESTAMP '2024-01-25') SELECT source_name, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(count(*) / (greatest(30.0, date_diff('microsecond', min(published_at), max(published_at)) / 1e6) / 3600), 6) END AS per_hour, least(1.0, count(*) / 200) AS confidence FROM r WHERE k <= 200 GROUP BY 1")
def _(s, d):
    return aggregates.throughput(V.articles(s, d), "source_name", "published_at", "id", F.lit("2024-01-25").cast("timestamp"))


@_query("w1_dedup_titles", SQL + "SELECT doc_id, source, title FROM docs QUALIFY row_number() OVER (PARTITION BY lang, lower(trim(coalesce(title, ''))) ORDER BY n_chars DESC, doc_id) = 1")
def _(s, d):
    return dedup.dedup_titles(V.documents(s, d), "lang", "title", [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source", "title")


@_query("w2_dedup_text", SQL + "SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM docs GROUP BY text")
def _(s, d):
    return dedup.keep_first(V.documents(s, d).withColumn("text_hash", F.sha2("text", 256)), ["text_hash"], [F.col("doc_id")]).select("doc_id", "text_hash")


@_query("w3_dedup_language_variants", SQL + "SELECT id, k AS symbol_id FROM (SELECT *, symbol_id % 10 AS k FROM articles) QUALIFY row_number() OVER (PARTITION BY k, time_bucket(INTERVAL 5 MINUTES, published_at), source_name ORDER BY score IS NULL, coalesce(score, -99) DESC, id) = 1")
def _(s, d):
    return dedup.dedup_language_variants(V.articles(s, d).withColumn("symbol_id", F.col("symbol_id") % 10), "symbol_id", "published_at", "source_name", "score").select("id", "symbol_id")


@_query("w4_compact_ranks", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS compact_rank FROM orders")
def _(s, d):
    orders = V.table(s, d, "orders").withColumn("day", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return dedup.compact_ranks(orders, "day", ["o_orderkey"], "o_orderpriority").select("o_orderkey", "o_orderpriority", F.col("compact_rank").cast("long").alias("compact_rank"))


@_query("w4_move_to_front", SQL + ", q AS (SELECT id, rank, added_at FROM queue WHERE id NOT IN (SELECT symbol_id FROM articles) UNION ALL SELECT DISTINCT symbol_id, 0, TIMESTAMP '2024-03-15' FROM articles) SELECT id, row_number() OVER (ORDER BY rank, added_at, id)::INT AS rank, added_at FROM q")
def _(s, d):
    return dedup.move_to_front(V.queue(s, d), V.articles(s, d).select(F.col("symbol_id").alias("id")), as_of())


@_query("w4_append_rank", SQL + ", n AS (SELECT DISTINCT symbol_id AS id FROM articles WHERE symbol_id NOT IN (SELECT id FROM queue)) SELECT id, rank, added_at FROM queue UNION ALL SELECT id, ((SELECT max(rank) FROM queue) + row_number() OVER (ORDER BY id))::INT, TIMESTAMP '2024-03-15' FROM n")
def _(s, d):
    return dedup.append_rank(V.queue(s, d), V.articles(s, d).select(F.col("symbol_id").alias("id")), as_of())


@_query("w5_newest_n", SQL + "SELECT id, symbol_id FROM articles QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id DESC) <= 12")
def _(s, d):
    return dedup.newest_n(V.articles(s, d), "symbol_id", 12, [F.desc("published_at"), F.desc("id")]).select("id", "symbol_id")


@_query("w7_cap_per_form", SQL + "SELECT id, form_type FROM (SELECT * FROM articles WHERE form_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id, form_type ORDER BY published_at DESC, id) <= 5) WHERE NOT coalesce(score < 0, false)")
def _(s, d):
    a = V.articles(s, d).filter("form_type IS NOT NULL")
    return dedup.cap_per_form(a, ["symbol_id", "form_type"], [F.desc("published_at"), F.col("id")], 5, a.filter("score < 0"), "id").select("id", "form_type")


@_query("w8_carry_forward", "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_said FROM conversations")
def _(s, d):
    c = V.table(s, d, "conversations").withColumn("said", F.when(F.col("role") == "user", F.col("text")))
    return dedup.carry_forward(c, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], ["said"]).select("conv_id", "turn", "role", "last_said")


@_query("w9_previous_state", SQL + "SELECT id, lag(score) OVER (PARTITION BY symbol_id ORDER BY published_at, id) AS previous_score FROM articles")
def _(s, d):
    return dedup.previous_state(V.articles(s, d), "symbol_id", [F.col("published_at"), F.col("id")], ["score"]).select("id", "previous_score")


@_query("w10_contribution_share", SQL + "SELECT id, round(CASE WHEN sum(abs(score)) OVER (PARTITION BY symbol_id) > 0 THEN abs(score) / sum(abs(score)) OVER (PARTITION BY symbol_id) * 100 ELSE 0 END, 6) AS share FROM articles WHERE score IS NOT NULL")
def _(s, d):
    return dedup.contribution_share(V.articles(s, d).filter("score IS NOT NULL"), "symbol_id", "score").select("id", F.round("share", 6).alias("share"))


@_query("w11_latest_order", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(s, d):
    return dedup.keep_first(V.table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@_query("w12_quarter_series", "SELECT o_custkey, o_orderkey, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS label, o_totalprice - CASE WHEN o_orderstatus = 'F' THEN 1000 ELSE 0 END AS burn FROM orders")
def _(s, d):
    o = V.table(s, d, "orders").withColumns({"operating_cash_flow": F.col("o_totalprice"), "capex": F.when(F.col("o_orderstatus") == "F", 1000.0)})
    return dedup.quarter_series(o, ts="o_orderdate").select("o_custkey", "o_orderkey", "label", "burn")


@_query("j3_symbols_with_unscored", SQL + "SELECT id FROM symbols WHERE EXISTS (SELECT 1 FROM articles a WHERE a.symbol_id = symbols.id AND score IS NULL)")
def _(s, d):
    return joins.symbols_with_unscored(V.symbols(s, d), V.articles(s, d)).select("id")


@_query("j4_symbols_without_feed", SQL + "SELECT id, company_name FROM symbols WHERE id NOT IN (SELECT symbol_id FROM feeds WHERE is_active AND feed_type = 'atom')")
def _(s, d):
    return joins.symbols_without_feed(V.symbols(s, d), V.feeds(s, d), ["atom"]).select("id", "company_name")


@_query("j4_customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def _(s, d):
    urgent = V.table(s, d, "orders").select(F.col("o_custkey").alias("symbol_id"), F.lit(True).alias("is_active"), F.left("o_orderpriority", F.lit(1)).alias("feed_type"))
    return joins.symbols_without_feed(V.table(s, d, "customer").select(F.col("c_custkey").alias("id")), urgent, ["1"]).select(F.col("id").alias("c_custkey"))


@_query("j4_feeds_without_articles", SQL + "SELECT id, feed_url FROM feeds WHERE id NOT IN (SELECT feed_id FROM stories)")
def _(s, d):
    return joins.feeds_without_articles(V.feeds(s, d), V.stories(s, d)).select("id", "feed_url")


@_query("j1_feeds_with_symbols", SQL + "SELECT f.id, company_name, feed_type, status FROM feeds f JOIN symbols s ON s.id = f.symbol_id")
def _(s, d):
    return joins.feeds_with_symbols(V.feeds(s, d), V.symbols(s, d)).select("id", "company_name", "feed_type", "status")


@_query("j5_has_feed_flag", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_order FROM customer")
def _(s, d):
    return joins.with_flag(V.table(s, d, "customer").select("c_custkey"), V.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "has_order")


@_query("j6_macro_multiplier", SQL + "SELECT s.id, coalesce(max(m.multiplier), 1.0) AS macro_multiplier FROM symbols s LEFT JOIN macro m ON s.industry <> '' AND contains(lower(m.industry_name), lower(s.industry)) GROUP BY 1")
def _(s, d):
    return joins.multiplier_by_containment(V.symbols(s, d), V.macro(s, d)).select("id", "macro_multiplier")


@_query("j6_macro_row", SQL + "SELECT s.id, coalesce(m.multiplier, 1.0) AS macro_multiplier, m.sector_name AS macro_sector, m.industry_name AS macro_industry, CASE WHEN m.sector_name IS NOT NULL THEN 'why ' || m.sector_name END AS macro_rationale FROM symbols s LEFT JOIN macro m ON s.industry <> '' AND contains(lower(m.industry_name), lower(s.industry)) QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY m.multiplier DESC NULLS LAST, m.sector_name, m.industry_name) = 1")
def _(s, d):
    told = V.macro(s, d).withColumn("rationale", F.concat(F.lit("why "), "sector_name"))
    return joins.macro_row_for(V.symbols(s, d), told).select("id", "macro_multiplier", "macro_sector", "macro_industry", "macro_rationale")


@_query("j7_snapshot_or_own", SQL + "SELECT p.id, m.at AS matched_at, coalesce(m.last, -s.exchange) AS close FROM articles p JOIN symbols s ON s.id = p.symbol_id LEFT JOIN (SELECT p.id, max(g.published_at) AS at, arg_max(g.id, (g.published_at, g.id)) AS last FROM articles p JOIN articles g ON g.symbol_id = p.symbol_id AND g.source_name = 'signup' AND g.published_at <= p.published_at GROUP BY 1) m ON m.id = p.id")
def _(s, d):
    a = V.articles(s, d)
    daily = a.filter("source_name = 'signup'").groupBy("symbol_id", "published_at").agg(F.max("id").alias("close"))
    own = V.symbols(s, d).select(F.col("id").alias("symbol_id"), (-F.col("exchange")).cast("long").alias("close"))
    rows = a.select("id", "symbol_id", "published_at").join(own.select("symbol_id"), "symbol_id", "left_semi")
    return joins.asof_backward(rows, daily, "symbol_id", "published_at", "published_at", ["close"], fallback=own).select("id", "matched_at", "close")


@_query("j7_asof_signup", SQL + "SELECT p.id, arg_max(g.published_at, g.published_at) AS matched_at, max(g.id) FILTER (g.published_at = m.at) AS signup_id FROM articles p LEFT JOIN (SELECT p.id, max(g.published_at) AS at FROM articles p JOIN articles g ON g.symbol_id = p.symbol_id AND g.source_name = 'signup' AND g.published_at <= p.published_at WHERE p.source_name = 'purchase' GROUP BY 1) m ON m.id = p.id LEFT JOIN articles g ON g.symbol_id = p.symbol_id AND g.source_name = 'signup' AND g.published_at = m.at WHERE p.source_name = 'purchase' GROUP BY 1")
def _(s, d):
    a = V.articles(s, d)
    buys = a.filter("source_name = 'purchase'").select("id", "symbol_id", "published_at")
    signups = a.filter("source_name = 'signup'").groupBy("symbol_id", "published_at").agg(F.max("id").alias("signup_id"))
    return joins.asof_backward(buys, signups, "symbol_id", "published_at", "published_at", ["signup_id"]).select("id", "matched_at", "signup_id")


@_query("j8_known_split", "SELECT event_id, event_type IN ('view', 'click') AS known FROM events")
def _(s, d):
    e = V.table(s, d, "events")
    return upsert.split_known(e.select("event_id"), e.filter("event_type IN ('view', 'click')"), "event_id")


@_query("j9_symbol_overview", SQL + "SELECT s.id, (SELECT count(*) FROM feeds f WHERE f.symbol_id = s.id AND is_active) AS active_feeds, (SELECT count(*) FROM feeds f WHERE f.symbol_id = s.id) AS total_feeds, (SELECT count(*) FROM stories a WHERE a.symbol_id = s.id) AS article_count, (SELECT max(rank) FROM queue q WHERE q.id = s.id) AS prio_rank FROM symbols s")
def _(s, d):
    return joins.symbol_overview(V.symbols(s, d).select("id"), V.feeds(s, d), V.stories(s, d), V.queue(s, d))


@_query("j11_reconcile_universe", SQL + "SELECT coalesce(l.id, t.id) AS id, coalesce(l.company_name, t.company_name) AS company_name, CASE WHEN t.id IS NULL THEN 'new' WHEN l.id IS NULL AND t.status THEN 'delisted' WHEN l.id IS NULL THEN 'unchanged' WHEN NOT t.status THEN 'restored' ELSE 'unchanged' END AS action FROM (SELECT * FROM symbols WHERE sector <> 'FURNITURE') l FULL JOIN (SELECT * FROM symbols WHERE exchange <> 3) t ON l.id = t.id")
def _(s, d):
    v = V.symbols(s, d)
    return joins.reconcile(v.filter("sector <> 'FURNITURE'"), v.filter("exchange <> 3"), "id", "company_name", "status")


@_query("j12_min_id_per_url", "SELECT min(page_id) AS page_id, regexp_replace(url, '[?#].*$', '') AS address FROM pages GROUP BY 2")
def _(s, d):
    return dedup.keep_first(V.table(s, d, "pages").withColumn("address", F.regexp_replace("url", r"[?#].*$", "")), ["address"], [F.col("page_id")]).select("page_id", "address")


@_query("j15_snap_to_catalog", """WITH e AS (SELECT DISTINCT p_type AS t, p_name AS n FROM part),
p AS (SELECT p_partkey, lower(CASE WHEN p_size % 4 = 0 THEN p_type || ' / ' || p_name WHEN p_size % 4 = 1 THEN p_name WHEN p_size % 4 = 2 THEN left(p_type, 4) || ' | ' || left(p_name, 3) ELSE left(p_type, 3) || ' > nothing' END) AS pick FROM part),
h AS (SELECT *, trim(split_part(replace(replace(pick, '/', '|'), '>', '|'), '|', 1)) AS sector, trim(split_part(replace(replace(pick, '/', '|'), '>', '|'), '|', 2)) AS industry FROM p),
r AS (SELECT p_partkey, t || ' | ' || n AS entry, n, CASE WHEN sector = lower(t) AND industry = lower(n) THEN 2 WHEN coalesce(nullif(industry, ''), sector) = lower(n) THEN 3 WHEN contains(lower(n), coalesce(nullif(industry, ''), sector)) THEN 4 WHEN contains(lower(t), sector) THEN 5 END AS k FROM h, e)
SELECT p_partkey, coalesce(entry, '') AS snapped FROM part LEFT JOIN (SELECT * FROM r WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k, CASE WHEN k >= 4 THEN -length(n) ELSE 0 END, entry) = 1) USING (p_partkey)""")
def _(s, d):
    p, k = V.table(s, d, "part"), F.col("p_size") % 4
    pick = (
        F.when(k == 0, F.concat(F.lit("[1] "), F.upper("p_type"), F.lit(" / "), F.col("p_name"))).when(k == 1, F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
        .when(k == 2, F.concat(F.left("p_type", F.lit(4)), F.lit(" | "), F.left("p_name", F.lit(3)))).otherwise(F.concat(F.left("p_type", F.lit(3)), F.lit(" > nothing")))
    )
    return joins.snap_to_catalog(p.select("p_partkey", pick.alias("pick")), p.select(F.col("p_type").alias("sector_name"), F.col("p_name").alias("industry_name"))).select("p_partkey", "snapped")


@_query("j16_sector_snap", """WITH n AS (SELECT DISTINCT p_type AS t FROM part), p AS (SELECT p_partkey, lower(CASE WHEN p_size % 3 = 0 THEN left(p_type, 5) WHEN p_size % 3 = 1 THEN p_type || ' goods' ELSE 'none such' END) AS pick FROM part)
SELECT p_partkey, coalesce((SELECT min(t) FROM n WHERE lower(t) = pick), (SELECT min(t) FROM n WHERE contains(lower(t), pick) OR contains(pick, lower(t))), '') AS snapped FROM p""")
def _(s, d):
    p, k = V.table(s, d, "part"), F.col("p_size") % 3
    pick = F.when(k == 0, F.left("p_type", F.lit(5))).when(k == 1, F.concat("p_type", F.lit(" goods"))).otherwise("none such")
    return joins.sector_snap(p.select("p_partkey", pick.alias("pick")), p.select(F.col("p_type").alias("sector_name"))).select("p_partkey", "snapped")


@_query("j16_industry_snap", """WITH n AS (SELECT DISTINCT p_type AS t, p_name AS i FROM part), p AS (SELECT p_partkey, p_type, lower(CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN split_part(p_name, ' ', 2) ELSE 'none such' END) AS pick FROM part)
SELECT p_partkey, p_type || ' | ' || coalesce((SELECT arg_min(i, (-length(i), i)) FROM n WHERE t = p_type AND lower(i) = pick), (SELECT arg_min(i, (-length(i), i)) FROM n WHERE t = p_type AND (contains(lower(i), pick) OR contains(pick, lower(i)))), (SELECT arg_min(i, (length(i), i)) FROM n WHERE t = p_type)) AS snapped FROM p""")
def _(s, d):
    p, k = V.table(s, d, "part"), F.col("p_size") % 3
    pick = F.when(k == 0, F.upper("p_name")).when(k == 1, F.get(F.split("p_name", " "), F.lit(1))).otherwise("none such")
    picks = p.select("p_partkey", pick.alias("pick"), F.col("p_type").alias("sector"))
    return joins.industry_snap(picks, p.select(F.col("p_type").alias("sector_name"), F.col("p_name").alias("industry_name"))).select("p_partkey", "snapped")


@_query("j17_cascading_multiplier", SQL + "SELECT p_partkey, coalesce(e.multiplier, (SELECT max(multiplier) FROM macro m WHERE contains(lower(m.sector_name), lower(left(p_type, 4)))), 1.0) AS multiplier FROM part LEFT JOIN macro e ON lower(e.sector_name) = lower(left(p_type, 4 + 20 * (p_size % 2))) AND lower(e.industry_name) = lower(p_name)")
def _(s, d):
    sector = F.when(F.col("p_size") % 2 == 1, F.upper("p_type")).otherwise(F.left("p_type", F.lit(4)))
    picks = V.table(s, d, "part").select("p_partkey", sector.alias("sector"), F.col("p_name").alias("pick"))
    return joins.cascading_multiplier(picks, V.macro(s, d)).select("p_partkey", "multiplier")


@_query("k1_append_new", "SELECT event_id, event_type FROM events")
def _(s, d):
    e = V.table(s, d, "events").select("event_id", "event_type")
    return upsert.append_new(e.filter("event_type IN ('view', 'error')"), e.unionByName(e), "event_id", [F.col("event_type")])


@_query("k2_upsert", "SELECT event_id, CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS value FROM events WHERE event_type <> 'error' OR event_id IS NULL")
def _(s, d):
    e = V.table(s, d, "events").select("event_id", "value", "event_type").filter("event_type <> 'error'")
    batch = e.filter("event_type = 'click'").withColumn("value", F.col("value") + 1)
    return upsert.upsert(e, batch, ["event_id"], [F.col("value")]).select("event_id", "value")


@_query("k3_keep_longer_text", SQL + "SELECT doc_id, CASE WHEN lang = 'en' AND length(text) > length(title) THEN text ELSE title END AS text, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS form FROM docs")
def _(s, d):
    v = V.documents(s, d)
    stored = v.select("doc_id", F.col("title").alias("text"), F.lit("old").alias("form"))
    return upsert.keep_longer(stored, v.filter("lang = 'en'").select("doc_id", "text", F.lit("new").alias("form")), ["doc_id"], "text", ["form"])


@_query("k4_raise_multiplier", SQL + ", g AS (SELECT p_type, p_name, max(1 + p_retailprice / 100000) AS m, arg_max(p_brand, 1e9 * p_retailprice + p_partkey) AS r FROM part GROUP BY 1, 2) SELECT sector_name, industry_name, round(greatest(multiplier, m), 6) AS multiplier, CASE WHEN m >= multiplier THEN r ELSE 'old' END AS rationale FROM macro LEFT JOIN g ON p_type = sector_name AND p_name = industry_name")
def _(s, d):
    signals = V.table(s, d, "part").select(F.col("p_type").alias("sector_name"), F.col("p_name").alias("industry_name"), (1 + F.col("p_retailprice") / 100000).alias("multiplier"), F.col("p_brand").alias("rationale"), F.col("p_partkey").alias("seq"))
    return upsert.raise_multiplier(V.macro(s, d).withColumn("rationale", F.lit("old")), signals, ["sector_name", "industry_name"]).withColumn("multiplier", F.round("multiplier", 6))


@_query("k5_patch_non_null", SQL + "SELECT id, CASE WHEN status AND balance > 5000 THEN 'patched' ELSE sector END AS sector FROM symbols")
def _(s, d):
    v = V.symbols(s, d)
    return upsert.patch_non_null(v.select("id", "sector"), v.filter("status").select("id", F.when(F.col("balance") > 5000, "patched").alias("sector")), "id", ["sector"])


@_query("k9_retype_feeds", SQL + "SELECT id, CASE WHEN feed_type = 'rss' AND (contains(feed_url, 'nasdaq.com/market-activity') OR contains(feed_url, 'yahoo.com/quote')) THEN 'html' ELSE feed_type END AS feed_type FROM feeds")
def _(s, d):
    return upsert.retype_feeds(V.feeds(s, d)).select("id", "feed_type")


@_query("k6_advance_date", "SELECT c_custkey, max(o_orderdate) AS filed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    o = V.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("filed"))
    old = V.table(s, d, "customer").select("c_custkey").join(o.groupBy("c_custkey").agg(F.min("filed").alias("filed")), "c_custkey", "left")
    return upsert.advance_date(old, o, "c_custkey", "filed")


@_query("k7_reset_scores", SQL + "SELECT id, CASE WHEN source_name = 'click' THEN NULL ELSE score END AS score FROM articles")
def _(s, d):
    return upsert.reset_where(V.articles(s, d), F.col("source_name") == "click", ["score"]).select("id", "score")


@_query("k8_delete_where", SQL + "SELECT id FROM articles WHERE form_type IS NULL OR form_type <> '10-K'")
def _(s, d):
    return upsert.delete_where(V.articles(s, d), F.col("form_type") == "10-K").select("id")


@_query("k10_run_audit", SQL + "SELECT 'score' AS step, TIMESTAMP '2024-03-15' AS finished_at, count(*) AS n_rows, count(*) FILTER (score IS NULL) AS n_failed, CASE WHEN count(*) FILTER (score IS NULL) = 0 THEN 'success' WHEN count(score) = 0 THEN 'failed' ELSE 'partial' END AS status FROM articles")
def _(s, d):
    return upsert.run_audit(V.articles(s, d), "score", as_of(), F.col("score").isNull())


@_query("p2_search_symbols", SQL + "SELECT id, company_name FROM symbols WHERE contains(lower(company_name), 'atom.xml/1') OR id IN (SELECT symbol_id FROM feeds WHERE contains(lower(feed_url), 'atom.xml/1'))")
def _(s, d):
    return selections.search_symbols(V.symbols(s, d), V.feeds(s, d), "ATOM.xml/1").select("id", "company_name")


def search_sql(query: str, mode: str, sort: str) -> str:
    """What ``symbol_search`` gives, from the views."""
    named = f"contains(lower(company_name), lower('{query}'))"
    hit = f"contains(lower(feed_url), lower('{query}'))"
    condition = {"zero": "article_count = 0", "low": "article_count BETWEEN 1 AND 4", "ok": "article_count >= 5", "nofeed": "total_feeds = 0", "priority": "prio_rank IS NOT NULL"}.get(mode, "true")
    order = {"articles": "article_count, ", "most": "article_count DESC, "}.get(sort, "")
    return f""", m AS (SELECT s.id, company_name, {named} AS named, (SELECT count(*) FROM feeds f WHERE f.symbol_id = s.id AND is_active AND ({named} OR {hit})) AS active_feeds,
    (SELECT count(*) FROM feeds f WHERE f.symbol_id = s.id AND ({named} OR {hit})) AS total_feeds, (SELECT count(*) FROM stories a WHERE a.symbol_id = s.id) AS article_count, (SELECT max(rank) FROM queue q WHERE q.id = s.id) AS prio_rank FROM symbols s)
    SELECT id, company_name, active_feeds, total_feeds, article_count, prio_rank FROM m WHERE (named OR total_feeds > 0) AND {condition} ORDER BY {order}company_name, id LIMIT 500"""


for _name, _query_text, _mode, _sort in (
    ("q12_symbol_search", "", "all", "alpha"), ("q12_search_by_feed", "www3.example", "all", "most"), ("q12_search_by_name", "customer#0000000", "all", "articles"), ("p4_zero", "", "zero", "alpha"),
    ("p4_low", "", "low", "articles"), ("p4_ok", "", "ok", "most"), ("p4_nofeed", "", "nofeed", "alpha"), ("p4_priority", "", "priority", "most"),
):

    # three documents to a symbol, and feeds of one kind: so there are symbols with few articles, and without feeds
    @_query(_name, SQL + search_sql(_query_text, _mode, _sort).replace("FROM stories a WHERE a.symbol_id", "FROM stories a WHERE a.id // 3" if _mode == "low" else "FROM stories a WHERE a.symbol_id").replace("FROM feeds f WHERE", "FROM feeds f WHERE feed_type = 'atom' AND" if _mode == "nofeed" else "FROM feeds f WHERE"))
    def _(s, d, q=_query_text, mode=_mode, sort=_sort):
        stories = V.stories(s, d).withColumn("symbol_id", F.floor(F.col("id") / 3)) if mode == "low" else V.stories(s, d)
        feeds = V.feeds(s, d).filter("feed_type = 'atom'") if mode == "nofeed" else V.feeds(s, d)
        return C.symbol_search(V.symbols(s, d), feeds, stories, V.queue(s, d), q, mode, sort)


@_query("p3_search_articles", SQL + "SELECT id, title FROM stories WHERE contains(lower(title), 'token') OR contains(lower(full_text), 'token')")
def _(s, d):
    return selections.search_articles(V.stories(s, d), "Token").select("id", "title")


@_query("p4_article_count_filter", SQL + "SELECT id, count(a.symbol_id) AS article_count FROM symbols s LEFT JOIN (SELECT symbol_id FROM articles) a ON a.symbol_id = s.id GROUP BY 1 HAVING count(a.symbol_id) >= 5")
def _(s, d):
    return selections.article_count_filter(joins.symbol_overview(V.symbols(s, d), V.feeds(s, d), V.articles(s, d)), "ok").select("id", "article_count")


@_query("p6_within_staleness", SQL + "SELECT id FROM filings WHERE date_diff('microsecond', published_at, TIMESTAMP '2025-06-01') / 86400e6 <= CASE WHEN form_type LIKE '10-K%' THEN 18 * 30.44 WHEN form_type LIKE '10-Q%' THEN 15 * 30.44 ELSE 90 END")
def _(s, d):
    return selections.within_staleness(V.filings(s, d), F.lit("2025-06-01").cast("timestamp")).select("id")


@_query("p7_material", SQL + "SELECT id, score FROM articles WHERE abs(score) >= 0.25")
def _(s, d):
    return V.articles(s, d).filter(scoring.material("score")).select("id", "score")


@_query("p9_exclude_sources", SQL + "SELECT id FROM articles WHERE form_type IS NULL OR form_type NOT IN ('8-K', '10-K')")
def _(s, d):
    return selections.exclude_sources(V.articles(s, d), ["8-K", "10-K"], "form_type").select("id")


@_query("p10_keyword_match", SQL + "SELECT doc_id FROM docs WHERE regexp_matches(text, '(?i)\\b(idiot|password|that)\\b')")
def _(s, d):
    return V.documents(s, d).filter(text.any_word("text", ["idiot", "password", "that"])).select("doc_id")


@_query("p17_validate", SQL + """SELECT id, (CASE WHEN trim(summary) = '' OR (length(full_text) > 0 AND length(trim(summary)) < greatest(100, length(full_text) // 4)) THEN 'summary,' ELSE '' END) || (CASE WHEN abs(score) > 0.9 THEN 'score,' ELSE '' END)
    || (CASE WHEN score <> 0 AND lang = 'de' THEN 'calibration,' ELSE '' END) || (CASE WHEN trim(title) = '' THEN 'forecast,' ELSE '' END) AS bad FROM stories""")
def _(s, d):
    v = V.stories(s, d).withColumns({"raw": (F.col("score") / 0.9).cast("string"), "calibration": F.when(F.col("lang") != "de", F.col("lang"))})
    checked = facts.validate_result(v, summary="summary", score="raw", calibration="calibration", forecast="title", previous="full_text")
    return checked.select("id", F.concat(F.array_join("violations", ","), F.when(F.col("valid"), "").otherwise(",")).alias("bad"))


@_query("f1_decay_weight", SQL + "SELECT id, round(w, 6) AS weight FROM weighted")
def _(s, d):
    return V.articles(s, d).select("id", F.round(scoring.decay_weight("published_at", as_of()), 6).alias("weight"))


@_query("f3_asymptotic_multiply", SQL + "SELECT id, round(CASE WHEN abs(score) <= 0.85 THEN greatest(-1.0, least(1.0, score * 1.05)) ELSE sign(score) * greatest(abs(score), least(1.0, 1 - (1 - abs(score)) * 0.95)) END, 6) AS raised FROM articles WHERE score IS NOT NULL")
def _(s, d):
    return V.articles(s, d).filter("score IS NOT NULL").select("id", F.round(scoring.asymptotic_multiply("score", F.lit(1.05)), 6).alias("raised"))


@_query("f4_gravity", SQL + "SELECT id, round(CASE WHEN score = 0 OR hours <= 336 THEN score ELSE score * exp(-0.0005 * (hours - 336)) END, 6) AS pulled FROM aged WHERE score IS NOT NULL")
def _(s, d):
    return V.articles(s, d).filter("score IS NOT NULL").select("id", F.round(scoring.gravity("score", "published_at", as_of()), 6).alias("pulled"))


@_query("f8_score_label", SQL + "SELECT id, CASE WHEN score >= 0.75 THEN 'STRONG BUY' WHEN score >= 0.6 THEN 'BUY' WHEN score >= 0.4 THEN 'NEUTRAL' WHEN score >= 0.25 THEN 'WEAK SELL' WHEN score IS NOT NULL THEN 'SELL' END AS label FROM articles")
def _(s, d):
    return V.articles(s, d).select("id", scoring.score_label("score").alias("label"))


@_query("f9_filing_signals", SQL + SIGNALS + "SELECT id, signal_type, modifier FROM signals")
def _(s, d):
    return C.filing_signals(V.filings(s, d)).select("id", "signal_type", "modifier")


@_query("f10_article_hash", SQL + "SELECT doc_id, sha256(source || '|' || title) AS hash FROM docs")
def _(s, d):
    return V.documents(s, d).select("doc_id", text.article_hash("source", "title", F.lit(None).cast("timestamp"), "url|title").alias("hash"))


@_query("f20_first_line", SQL + "SELECT doc_id, left(title, 200) AS title FROM docs WHERE length(title) BETWEEN 20 AND 250")
def _(s, d):
    v = V.documents(s, d)
    return v.filter(F.length(text.first_line("text")).between(20, 250)).select("doc_id", text.clip_text(text.first_line("text"), "title").alias("title"))


@_query("f20_filing_title", SQL + "SELECT id, " + title_sql("full_text", "url") + " AS title FROM stories")
def _(s, d):
    return V.stories(s, d).select("id", facts.filing_title("full_text", F.col("url")).alias("title"))


@_query("f17_first_number", SQL + "SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '[+-]?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS number FROM docs")
def _(s, d):
    return V.documents(s, d).select("doc_id", text.first_number("text").alias("number"))


@_query("t1_sort_leaderboard", SQL + "SELECT id, company_name, balance FROM symbols ORDER BY company_name, id LIMIT 100")
def _(s, d):
    by_name = worklists.sort_leaderboard(V.symbols(s, d), "no such column", descending=False, allowed=("company_name", "balance"))
    return worklists.page(by_name, ["company_name", "id"], 1, 100).select("id", "company_name", "balance")


@_query("t2_page", SQL + "SELECT id FROM articles ORDER BY published_at DESC, id LIMIT 40 OFFSET 80")
def _(s, d):
    return worklists.page(V.articles(s, d), [F.desc("published_at"), "id"], 3, 40).select("id")


@_query("t5_first_n_symbols", SQL + "SELECT id, symbol_id FROM articles WHERE symbol_id IN (SELECT DISTINCT symbol_id FROM articles ORDER BY 1 LIMIT 10)")
def _(s, d):
    return dedup.first_n_keys(V.articles(s, d), "symbol_id", 10).select("id", "symbol_id")


@_query("t6_score_swings", SQL + ", b AS (SELECT symbol_id, " + exact_mean_sql("score", 6) + " AS old, " + exact_mean_sql("CASE WHEN form_type IS NOT NULL THEN score END", 6) + " AS new FROM articles GROUP BY 1) SELECT symbol_id, round(abs(new - old), 6) AS swing FROM b WHERE abs(new - old) > 0.01 ORDER BY abs(new - old) DESC, symbol_id LIMIT 20")
def _(s, d):
    by = V.articles(s, d).groupBy("symbol_id")
    old = by.agg(aggregates.exact_mean("score", 6).alias("score"))
    new = by.agg(aggregates.exact_mean(F.when(F.col("form_type").isNotNull(), F.col("score")), 6).alias("score"))
    return worklists.score_swings(old, new).select("symbol_id", F.round("swing", 6).alias("swing"))


@_query("t7_macro_ranking", SQL + "SELECT sector_name, industry_name, multiplier, greatest(0, least(100, floor((multiplier - 1) / 0.05 * 100 + 1e-9)))::INT AS bar FROM macro ORDER BY multiplier DESC, sector_name, industry_name LIMIT 100")
def _(s, d):
    return worklists.macro_ranking(V.macro(s, d), 100)


@_query("u1_scoring_window", SQL + "SELECT id, symbol_id FROM aged WHERE form_type IS NOT NULL AND hours / 24 <= CASE WHEN form_type = '10-K' THEN 547.92 ELSE 90 END UNION ALL (SELECT id, symbol_id FROM articles WHERE form_type IS NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY published_at DESC, id DESC) <= 12)")
def _(s, d):
    return C.scoring_window(V.articles(s, d), as_of()).select("id", "symbol_id")


@_query("u2_union_priority", "SELECT event_id, CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS side FROM events")
def _(s, d):
    e = V.table(s, d, "events")
    return joins.union_priority(e.filter("event_type = 'view'").select("event_id", F.lit(1).alias("side")), e.select("event_id", F.lit(2).alias("side")), "event_id")


@_query("u3_removed", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def _(s, d):
    return joins.removed(V.table(s, d, "orders").filter("o_orderpriority LIKE '1%'").withColumnRenamed("o_custkey", "c_custkey"), V.table(s, d, "customer"), "c_custkey")


@_query("u3_added", SQL + "SELECT user_id AS id FROM events EXCEPT SELECT id FROM queue")
def _(s, d):
    return joins.added(V.table(s, d, "events").select(F.col("user_id").alias("id")), V.queue(s, d), "id")


@_query("u3_kept", SQL + "SELECT user_id AS id FROM events INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(s, d):
    return joins.kept(V.table(s, d, "events").select(F.col("user_id").alias("id")), V.symbols(s, d).filter("status"), "id")


@_query("s11_strip_html", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM pages")
def _(s, d):
    return V.table(s, d, "pages").select("page_id", text.strip_html("html").alias("body"))

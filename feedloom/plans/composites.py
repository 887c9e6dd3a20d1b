"""Composite jobs, each one plan over all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import article_hash, contains_ci
from ..operators import aggregates, dedup, facts, joins, selections, upsert
from ..operators.filings import REGISTRY, Form, filing_signals, of_form  # noqa: F401  part of this module's interface
from ..sources import parse


def _pulled(symbols: DataFrame, means: DataFrame, macro: DataFrame, as_of: Column) -> DataFrame:
    """Means of active symbols after their multipliers and the pull of silence, as ``pulled``."""
    if "status" in symbols.columns:
        symbols = symbols.filter("status")
    ai = F.coalesce(F.col("ai_multiplier").cast("double"), F.lit(1.0)) if "ai_multiplier" in symbols.columns else F.lit(1.0)
    rated = joins.multiplier_by_containment(symbols, macro).select(F.col("id").alias("symbol_id"), "macro_multiplier", ai.alias("ai_multiplier"))
    raised = scoring.asymptotic_multiply("mean_score", F.col("macro_multiplier") * F.col("ai_multiplier"))
    found = means.filter("mean_score IS NOT NULL").join(rated, "symbol_id").withColumn("raised", raised)
    return found.withColumn("pulled", scoring.gravity("raised", "newest", as_of))


def final_scores(symbols: DataFrame, articles: DataFrame, macro: DataFrame, as_of: Column) -> DataFrame:
    """One score per active symbol: decayed mean, both multipliers, pull when silent.

    ``symbols`` has ``id, industry`` and may have ``status`` and ``ai_multiplier``,
    its stored sector multiplier (1 where missing or null); ``articles`` has
    ``symbol_id, score, published_at``. Symbols without material articles get none.
    """
    means = aggregates.decayed_mean(articles, "symbol_id", "score", "published_at", as_of)
    final = F.round(scoring.clamp(F.col("pulled"), -1.0, 1.0), 6)
    return _pulled(symbols, means, macro, as_of).select("symbol_id", "n_material", "macro_multiplier", "ai_multiplier", final.alias("final_score"))


def source_weight(articles: DataFrame, registry: tuple[Form, ...] = REGISTRY) -> Column:
    """What an article weighs by its form: as stamped, else as the registry has it; news weighs one."""
    stamped = [F.nullif(F.col("sec_source_weight").cast("double"), F.lit(0.0))] if "sec_source_weight" in articles.columns else []
    return F.coalesce(*stamped, of_form(registry, "weight"), F.lit(1.0))


def final_scores_with_signals(symbols: DataFrame, articles: DataFrame, macro: DataFrame, signals: DataFrame, as_of: Column, registry: tuple[Form, ...] = REGISTRY) -> DataFrame:
    """As above, articles weighted by source, and the modifier of filings added before the clamp.

    The modifier is the sum of active signals, less the penalty for a late annual
    report by ``last_10k_filed`` of ``symbols``. A symbol with annual or quarterly
    reports, or amendments of these, of which none is scored, has no score.
    """
    means = aggregates.decayed_mean(articles, "symbol_id", "score", "published_at", as_of, weight=source_weight(articles, registry))
    extra = aggregates.sec_modifier(signals, symbols, as_of)
    guard = aggregates.tier1_coverage_guard(articles).select("symbol_id", "blocked")
    total = scoring.clamp(F.col("pulled") + F.coalesce("sec_modifier", F.lit(0.0)), -1.0, 1.0)
    found = _pulled(symbols, means, macro, as_of).join(extra, "symbol_id", "left").join(guard, "symbol_id", "left")
    return found.select("symbol_id", "sec_modifier", F.when(~F.coalesce("blocked", F.lit(False)), F.round(total, 6)).alias("final_score"))


def scoring_window(articles: DataFrame, as_of: Column, newest_news: int = 12) -> DataFrame:
    """Filings still fresh by form, and the newest articles that are no filings."""
    filings = selections.within_staleness(articles.filter("form_type IS NOT NULL"), as_of)
    news = dedup.newest_n(articles.filter("form_type IS NULL"), "symbol_id", newest_news, [F.desc("published_at"), F.desc("id")])
    return filings.unionByName(news)


def symbol_search(
    symbols: DataFrame, feeds: DataFrame, articles: DataFrame, queue: DataFrame, query: str = "", mode: str = "all", sort: str = "alpha", most: int = 500, names: tuple[str, ...] = ("company_name",)
) -> DataFrame:
    """Symbols by name or feed address, with their counts, in one of the modes and orders.

    Of a symbol that only a feed's address brings in, those feeds alone count.
    ``mode`` as for ``article_count_filter``; ``sort``: ``alpha``, ``articles``
    (fewest first) or ``most``.
    """
    named = F.lit(not query.strip())
    for name in names:
        named = named | contains_ci(F.col(name).cast("string"), query)
    hit = contains_ci("feed_url", query)
    of_feeds = feeds.groupBy(F.col("symbol_id").alias("id")).agg(
        F.count_if("is_active").alias("_a"), F.count("*").alias("_t"), F.count_if(F.col("is_active") & hit).alias("_ah"), F.count_if(hit).alias("_th")
    )
    of_articles = articles.groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("article_count"))
    ranks = queue.groupBy("id").agg(F.max("rank").alias("prio_rank"))
    found = symbols.withColumn("_named", named).join(of_feeds, "id", "left").na.fill(0, ["_a", "_t", "_ah", "_th"]).filter("_named OR _th > 0")
    counted = found.join(of_articles, "id", "left").join(ranks, "id", "left").na.fill(0, ["article_count"]).select(
        "id", *names, F.when(F.col("_named"), F.col("_a")).otherwise(F.col("_ah")).alias("active_feeds"),
        F.when(F.col("_named"), F.col("_t")).otherwise(F.col("_th")).alias("total_feeds"), "article_count", "prio_rank",
    )
    order = {"articles": [F.asc("article_count")], "most": [F.desc("article_count")]}.get(sort, [])
    return selections.article_count_filter(counted, mode).orderBy(*order, *names, "id").limit(most)


def ingest_articles(raw: DataFrame, stored: DataFrame, *, recipe: str = "url|title|time") -> DataFrame:
    """The stored articles after a batch of parsed ones.

    ``raw`` has ``url, title, published_at, summary, html`` and whatever else
    ``stored`` has; rows need a title. The page's text, where it has one, stands
    beside the summary; of equal hashes the first by address counts, and what is
    stored stays as it is.
    """
    hashed = selections.nonblank_title(raw).withColumn("article_hash", article_hash("url", "title", "published_at", recipe))
    fresh = hashed.join(stored.select("article_hash"), "article_hash", "left_anti")
    read = fresh.withColumn("full_text", F.coalesce(parse.body_text("html"), F.lit("")))
    return upsert.append_new(stored, read.select(*stored.columns), "article_hash", [F.col("url"), F.col("title")])


def refresh_sector_map(screener: DataFrame, symbols: DataFrame, catalog: DataFrame, snapshots: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """One refresh from a normalised screener: ``catalog``, ``symbols``, ``snapshots`` and ``stats``.

    New sector and industry pairs join the catalog, unrated; symbols take over
    what is not null; each gets one snapshot a day as JSON, of which the latest
    counts. ``symbols`` has ``id, symbol`` and may have the screener's columns;
    ``catalog`` has ``sector_name, industry_name, multiplier, last_llm_run_at``;
    ``snapshots`` has ``symbol_id, snapshot_date, data``.
    """
    rows = screener.join(symbols.select(F.col("id"), F.upper("symbol").alias("ticker")), "ticker").withColumns({c: F.nullif(c, F.lit("")) for c in ("sector", "industry")})
    pairs = rows.filter("sector IS NOT NULL AND industry IS NOT NULL").select(F.col("sector").alias("sector_name"), F.col("industry").alias("industry_name")).distinct()
    new = pairs.join(catalog, ["sector_name", "industry_name"], "left_anti").withColumns({"multiplier": F.lit(1.0), "last_llm_run_at": F.lit(None).cast("timestamp")})
    grown = catalog.unionByName(new.select(*catalog.columns))
    patched = upsert.patch_non_null(symbols, rows, "id", [c for c in rows.columns if c in symbols.columns and c not in ("id", "symbol")])
    values = [c for c in rows.columns if c not in ("id", "ticker")]
    today = rows.select(F.col("id").alias("symbol_id"), as_of.cast("date").alias("snapshot_date"), F.to_json(F.struct(*values)).alias("data"))
    kept = upsert.upsert(snapshots, today.select(*snapshots.columns), ["symbol_id", "snapshot_date"], [F.col("data")])
    known = symbols.select("id").join(rows.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    stats = known.agg(F.count("_hit").alias("mapped"), F.count_if(F.col("_hit").isNull()).alias("missing"))
    return {"catalog": grown, "symbols": patched, "snapshots": kept, "stats": stats}


def sync_universe(live: DataFrame, symbols: DataFrame, exchange: str, as_of: Column) -> dict[str, DataFrame]:
    """Bring stored symbols of an exchange in line with its live listing.

    ``live`` has ``ticker`` (EXCHANGE:NAME) and ``company_name``; ``symbols`` has
    ``symbol, company_name, status``. Gives ``actions`` by symbol, ``symbols``
    after them, and the ``audit`` row.
    """
    listed = selections.live_exchange(live, exchange).select(F.upper(F.split_part("ticker", F.lit(":"), F.lit(2))).alias("symbol"), "company_name")
    listed = dedup.keep_first(listed, ["symbol"], [F.col("company_name")])
    actions = joins.reconcile(listed, symbols, "symbol", "company_name", "status")
    status = F.when(F.col("action") == "delisted", False).when(F.col("action").isin("new", "restored"), True).otherwise(F.coalesce("status", F.lit(False)))
    after = actions.join(symbols.select("symbol", "status"), "symbol", "left").select("symbol", "company_name", status.alias("status"))
    return {"actions": actions, "symbols": after, "audit": upsert.run_audit(actions, "sync_universe", as_of, F.lit(False))}


def research_multipliers(pending: DataFrame, catalog: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """Raise catalog multipliers by rated research, and mark its articles as done.

    ``pending`` has ``article_id, sector_name, industry_name, growth, rationale,
    seq``; ``catalog`` ``sector_name, industry_name, multiplier, rationale``;
    ``articles`` ``id, llm_processed``.
    """
    signals = pending.withColumn("multiplier", scoring.growth_to_multiplier("growth"))
    raised = upsert.raise_multiplier(catalog, signals, ["sector_name", "industry_name"])
    return {"catalog": raised, "articles": upsert.mark_processed(articles, pending.select(F.col("article_id").alias("id")), "id", "llm_processed")}


# Figures of the annual and the quarterly charts.
ANNUAL_FIGURES = (
    "revenue", "gross_margin", "operating_margin", "net_margin", "operating_cash_flow", "free_cash_flow", "net_income", "cash_and_equivalents", "total_debt",
    "shares_outstanding", "rd_spend", "sga_spend",
)
QUARTERLY_FIGURES = ("revenue", "gross_margin", "operating_margin", "net_margin", "operating_cash_flow", "capex", "cash_and_equivalents")


def filing_dashboard(filings: DataFrame, signals: DataFrame, scored: DataFrame, as_of: Column, *, n: int = 200, n_signals: int = 100, last: int = 5) -> dict[str, DataFrame]:
    """What a dashboard of filings shows, for all symbols at once or those of the tables.

    ``filings``: ``id, symbol_id, form_type, published_at, score, title,
    article_summary, extracted_facts`` (JSON); ``signals`` as of
    ``filing_signals``; ``scored``: scored articles of any form. Tables:
    ``counts`` by family, ``annual`` and ``quarterly`` figures of the last
    filings, ``events``, ``composition`` and ``coverage``.
    """
    newest = dedup.newest_n(filings.filter("form_type IS NOT NULL"), "symbol_id", n, [F.desc("published_at"), F.desc("id")])
    recent = dedup.newest_n(signals, "symbol_id", n_signals, [F.desc("filed_at"), F.desc("id"), F.col("signal_type")])
    by_family = dedup.last_n_by_family(newest, last, family=aggregates.family("form_type"))

    def figures(family: str, names: tuple[str, ...]) -> DataFrame:
        own = by_family.filter(F.col("family") == family)
        found = facts.extract_figures(own.select("id", "extracted_facts"), "extracted_facts", list(names))
        wide = found.groupBy("id").agg(*(F.max(F.when(F.col("key") == x, F.col("amount"))).alias(x) for x in names))
        return own.select("id", "symbol_id", "published_at").join(wide, "id", "left")

    annual = figures("10-K", ANNUAL_FIGURES).withColumn("label", F.year("published_at").cast("string"))
    return {
        "counts": aggregates.family_counts(newest, "symbol_id", "form_type"),
        "annual": annual,
        "quarterly": dedup.quarter_series(figures("10-Q", QUARTERLY_FIGURES)),
        "events": selections.event_timelines(newest, recent),
        "composition": aggregates.score_composition(scored),
        "coverage": aggregates.coverage_heatmap(newest, as_of, keys=("symbol_id",)),
    }


def symbol_report(
    symbols: DataFrame, articles: DataFrame, macro: DataFrame, snapshots: DataFrame, n: int = 50, *, research: DataFrame | None = None, connections: DataFrame | None = None
) -> dict[str, DataFrame]:
    """What a symbol's page shows, of all symbols at once, as tables by ``symbol_id``.

    ``articles``: the newest ``n`` scored ones with their share of the score,
    beside the symbol's name, multipliers, decomposed score and latest snapshot;
    ``symbols`` has ``sector, final_score, ai_multiplier``, ``macro`` a
    ``rationale``. ``research`` (``id, published_at, title, summary,
    llm_processed``) gives ``related``, and ``connections`` (``symbol_id,
    relation, names``) the distinct names of each relation.
    """
    newest = dedup.newest_n(articles.filter("score IS NOT NULL"), "symbol_id", n, [F.desc("published_at"), F.desc("id")])
    shares = dedup.contribution_share(newest, "symbol_id", "score", least_total=1e-9)
    rated = scoring.score_decomposition(joins.macro_row_for(symbols, macro))
    latest = dedup.keep_first(snapshots, ["symbol_id"], [F.desc("snapshot_date")]).select("symbol_id", "snapshot_date", "data")
    own = rated.select(
        F.col("id").alias("symbol_id"), "company_name", "macro_multiplier", "macro_sector", "macro_rationale", "final_score", "base_score", "macro_boost", "ai_boost"
    )
    told = shares.select("id", "symbol_id", "published_at", "score", "share").join(own, "symbol_id").join(latest, "symbol_id", "left")
    out = {"articles": told}
    if research is not None:
        out["related"] = joins.related_research(symbols, macro, research)
    if connections is not None:
        by_relation = connections.select(F.struct("symbol_id", "relation").alias("_of"), "names")
        out["connections"] = aggregates.connection_sets(by_relation, "_of", "names").select("_of.symbol_id", "_of.relation", "name")
    return out


def dedup_all(articles: DataFrame, *, key: str = "symbol_id", url: str = "url", title: str = "title", source: str = "source_name", score: str = "score", ts: str = "published_at", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Articles without repeated addresses, titles and language variants; and the rows after each step.

    Each step marks what it keeps among the rows that the one before kept, so one
    run over the articles counts all steps. Marks, not observed metrics: these
    count a stage's rows twice when it runs again for a lost executor.
    """
    marked = dedup.mark_first(articles, "_urls", [key, url], [F.col(id_col)])
    marked = dedup.mark_first(marked, "_titles", dedup.title_keys(key, title), [F.col(score).isNull(), F.col(ts).desc_nulls_last(), F.col(id_col)], among="_urls")
    order = dedup.variant_order(score, F.col(url).contains("/0/en/"), id_col)
    marked = dedup.mark_first(marked, "_variants", dedup.variant_keys(key, ts, source), order, among="_titles")
    names = ("urls", "titles", "variants")
    counted = marked.agg(F.count("*").alias("before"), *(F.count_if(f"_{x}").alias(x) for x in names))
    steps = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(x).alias("step"), F.col(x).alias("n")) for i, x in enumerate(("before", *names))))
    return marked.filter("_variants").drop(*(f"_{x}" for x in names)), counted.select(F.explode(steps).alias("s")).select("s.*")


def data_health(symbols: DataFrame, feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """``report, item, n``: feeds and articles by source, and what is missing or double."""
    line = lambda df, report, item: df.select(F.lit(report).alias("report"), item.cast("string").alias("item"), F.col("n").cast("long").alias("n"))
    total = lambda df: df.agg(F.count("*").alias("n"))
    silent = aggregates.feed_article_counts(feeds, articles).filter("article_count = 0")
    parts = [
        line(silent.groupBy("feed_type").agg(F.count("*").alias("n")), "feeds without articles", F.col("feed_type")),
        line(aggregates.zero_article_domains(feeds, articles), "hosts without articles", F.col("host")),
        line(articles.groupBy("source_name").agg(F.count("*").alias("n")), "articles by source", F.col("source_name")),
        line(total(joins.symbols_without_feed(symbols, feeds)), "symbols without feed", F.lit(None)),
        line(total(dedup.duplicate_groups(articles, ["symbol_id", F.lower(F.trim("title")).alias("t")])), "repeated titles", F.lit(None)),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out

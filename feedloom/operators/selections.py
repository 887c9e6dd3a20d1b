"""Filters and projections over symbols, feeds, articles and filings.

Symbols have ``id, company_name, status, exchange, industry, sector``; feeds
``id, symbol_id, feed_url, feed_type, is_active``; articles ``id, symbol_id,
feed_id, title, published_at, source_name, form_type, score``. Functions name
other columns that they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import contains_ci
from .dedup import newest_n


def active_feeds(feeds: DataFrame, symbols: DataFrame, exchange, types: list[str], *, inactive_too: bool = False) -> DataFrame:
    """Feeds of the types whose symbol is listed on the exchange, whatever the symbol's status."""
    wanted = feeds.filter(F.col("feed_type").isin(types))
    if not inactive_too:
        wanted = wanted.filter("is_active")
    listed = symbols.filter(F.col("exchange") == F.lit(exchange)).select(F.col("id").alias("symbol_id"), "company_name")
    return wanted.join(listed, "symbol_id")


def search_symbols(symbols: DataFrame, feeds: DataFrame, query: str, names: tuple[str, ...] = ("company_name",)) -> DataFrame:
    """Symbols of which a name or the address of a feed contains the query, whatever the case.

    A blank query finds all. The query is plain text, without wildcards.
    """
    if not query.strip():
        return symbols
    hit = F.lit(False)
    for name in names:
        hit = hit | contains_ci(F.col(name).cast("string"), query)
    by_feed = feeds.filter(contains_ci("feed_url", query)).select(F.col("symbol_id").alias("id")).distinct().withColumn("_by_feed", F.lit(True))
    return symbols.join(by_feed, "id", "left").filter(hit | F.col("_by_feed").isNotNull()).drop("_by_feed")


def search_articles(articles: DataFrame, query: str, title: str = "title", text: str = "full_text") -> DataFrame:
    return articles.filter(contains_ci(title, query) | contains_ci(text, query))


def article_count_filter(counted: DataFrame, mode: str) -> DataFrame:
    """``zero``, ``low`` (1 to 4), ``ok`` (5 and more), ``nofeed`` or ``priority``; else all.

    ``counted`` has ``article_count``, ``total_feeds`` and ``prio_rank``.
    """
    n = F.col("article_count")
    conditions = {
        "zero": n == 0, "low": n.between(1, 4), "ok": n >= 5, "nofeed": F.col("total_feeds") == 0, "priority": F.col("prio_rank").isNotNull(),
    }
    return counted.filter(conditions[mode]) if mode in conditions else counted


def is_scored(score: str = "score") -> Column:
    return F.col(score).isNotNull()


def unscored(df: DataFrame, score: str = "score") -> DataFrame:
    return df.filter(~is_scored(score))


#: Days for which a filing counts as fresh, by the beginning of its form.
FRESH_DAYS = (("10-K", 18 * scoring.DAYS_PER_MONTH), ("10-Q", 15 * scoring.DAYS_PER_MONTH))
OTHER_FRESH_DAYS = 90.0


def within_staleness(df: DataFrame, as_of: Column, *, form: str = "form_type", ts: str = "published_at") -> DataFrame:
    """Rows fresh enough for their form."""
    days = F.lit(OTHER_FRESH_DAYS)
    for name, most in FRESH_DAYS:
        days = F.when(F.col(form).startswith(name), most).otherwise(days)
    return df.filter(scoring.age_days(ts, as_of) <= days)


def exclude_sources(df: DataFrame, names: list[str], column: str = "source_name") -> DataFrame:
    """Rows of other sources; an unknown source stays."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(names))


def publisher_allow_list(df: DataFrame, names: list[str], column: str = "source_name") -> DataFrame:
    return df.filter(F.col(column).isin(names))


def nonblank_title(df: DataFrame, title: str = "title") -> DataFrame:
    return df.filter(F.trim(title) != "")


def presence_flags(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """A boolean column for each ``name: column``: whether the column has a value."""
    return df.withColumns({name: F.col(c).isNotNull() for name, c in flags.items()})


def live_exchange(df: DataFrame, exchange: str, ticker: str = "ticker") -> DataFrame:
    """Rows whose ticker is written as ``EXCHANGE:NAME`` for this exchange."""
    return df.filter(F.col(ticker).startswith(f"{exchange}:"))


def new_industries(catalog: DataFrame, last_run: str = "last_llm_run_at") -> DataFrame:
    """How many catalog entries were never rated."""
    return catalog.agg(F.count_if(F.col(last_run).isNull()).alias("new_industries"))


def pending_research(df: DataFrame, limit: int, *, done: str = "llm_processed", ts: str = "published_at", id_col: str = "id") -> DataFrame:
    """The newest unprocessed articles; unknown counts as unprocessed."""
    return df.filter(~F.coalesce(F.col(done), F.lit(False))).orderBy(F.desc(ts), id_col).limit(limit)


def event_timelines(filings: DataFrame, signals: DataFrame) -> DataFrame:
    """One tagged union of dated events: current reports, insider trades, dilution, late notices.

    ``filings`` has ``symbol_id, form_type, published_at, score, title,
    article_summary``; ``signals`` has ``symbol_id, signal_type, filed_at,
    signal_value, modifier``. Titles are cut to 80 and summaries to 120.
    """
    form = F.col("form_type")
    kind = (
        F.when(form.isin("8-K", "8-K/A"), "event").when(form.startswith("S-3") | form.startswith("424B"), "dilution").when(form.startswith("NT"), "late_notice")
    )
    from_filings = filings.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "symbol_id", "kind", F.to_date("published_at").alias("day"), "form_type", F.coalesce("score", F.lit(0.0)).cast("double").alias("amount"),
        F.lit(None).cast("double").alias("modifier"), F.left(F.coalesce("title", F.lit("")), F.lit(80)).alias("title"),
        F.when(F.col("kind") == "event", F.left(F.coalesce("article_summary", F.lit("")), F.lit(120))).alias("summary"),
    )
    insiders = signals.filter(F.col("signal_type").isin("insider_buy", "insider_sell")).select(
        "symbol_id", F.col("signal_type").alias("kind"), F.to_date("filed_at").alias("day"), F.lit("4").alias("form_type"),
        F.coalesce("signal_value", F.lit(0.0)).cast("double").alias("amount"), F.coalesce("modifier", F.lit(0.0)).cast("double").alias("modifier"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("summary"),
    )
    return from_filings.unionByName(insiders)


def filing_detail(symbols: DataFrame, articles: DataFrame, name, n: int = 50, name_col: str = "company_name") -> DataFrame:
    """The newest ``n`` filings of the active symbol of that name."""
    one = symbols.filter("status").filter(F.col(name_col) == F.lit(name)).select(F.col("id").alias("symbol_id"))
    filings = articles.filter("form_type IS NOT NULL").join(one, "symbol_id", "left_semi")
    return newest_n(filings, "symbol_id", n, [F.desc("published_at"), F.desc("id")])

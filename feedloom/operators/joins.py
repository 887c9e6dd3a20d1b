"""Joins: as-of, containing, cascading, reconciling, and the plain ones by name.

Nothing here is broadcast by hand: the optimizer broadcasts what is small by its
size, and every join has a key to shuffle on beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import has_word
from . import dedup
from .dedup import newest_n

# ---------------------------------------------------------------- by name


def feeds_with_symbols(feeds: DataFrame, symbols: DataFrame) -> DataFrame:
    return feeds.join(symbols.select(F.col("id").alias("symbol_id"), "company_name", "exchange", "status"), "symbol_id")


def articles_with_feed(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every article, with its feed's address and type where it has one."""
    return articles.join(feeds.select(F.col("id").alias("feed_id"), "feed_url", "feed_type"), "feed_id", "left")


def symbols_with_unscored(symbols: DataFrame, articles: DataFrame, score: str = "score") -> DataFrame:
    return symbols.join(articles.filter(F.col(score).isNull()).select(F.col("symbol_id").alias("id")), "id", "left_semi")


def symbols_without_feed(symbols: DataFrame, feeds: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Symbols that have no active feed, of the types if they are given."""
    live = feeds.filter("is_active")
    live = live.filter(F.col("feed_type").isin(types)) if types else live
    return symbols.join(live.select(F.col("symbol_id").alias("id")), "id", "left_anti")


def feeds_without_articles(feeds: DataFrame, articles: DataFrame) -> DataFrame:
    return feeds.join(articles.select(F.col("feed_id").alias("id")), "id", "left_anti")


def symbol_overview(symbols: DataFrame, feeds: DataFrame, articles: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """Feeds, articles and queue rank of each symbol; each side is aggregated before it is joined."""
    of_feeds = feeds.groupBy(F.col("symbol_id").alias("id")).agg(F.count_if("is_active").alias("active_feeds"), F.count("*").alias("total_feeds"))
    of_articles = articles.groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("article_count"))
    out = symbols.join(of_feeds, "id", "left").join(of_articles, "id", "left").na.fill(0, ["active_feeds", "total_feeds", "article_count"])
    if queue is None:
        return out.withColumn("prio_rank", F.lit(None).cast("int"))
    return out.join(queue.groupBy("id").agg(F.max("rank").alias("prio_rank")), "id", "left")


def symbol_sector(symbols: DataFrame, catalog: DataFrame) -> DataFrame:
    """Symbols with their catalog entry, by ``sector_id``; without one, nulls."""
    return symbols.join(catalog.select("sector_id", "sector_name", "industry_name", "multiplier"), "sector_id", "left")


def in_flight(active: DataFrame, symbols: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """Work under way: ``id, company_name, started_at, elapsed`` seconds, ``unscored``.

    ``active`` has ``symbol_id, started_at``; a symbol without unscored articles
    stays, with none.
    """
    open_rows = articles.filter("score IS NULL").groupBy("symbol_id").agg(F.count("*").alias("unscored"))
    named = active.join(symbols.select(F.col("id").alias("symbol_id"), "company_name"), "symbol_id")
    return named.join(open_rows, "symbol_id", "left").select(
        F.col("symbol_id").alias("id"), "company_name", "started_at", scoring.seconds_between("started_at", as_of).alias("elapsed"), F.coalesce("unscored", F.lit(0)).alias("unscored")
    )


def cik_lookup(symbols: DataFrame, cik_map: DataFrame, ticker: str = "symbol") -> DataFrame:
    """Symbols with their number; ``cik`` is null where the map has none."""
    return symbols.join(cik_map.select(F.col("ticker").alias("_ticker"), "cik"), F.upper(ticker) == F.col("_ticker"), "left").drop("_ticker")


def lookup_misses(joined: DataFrame, column: str) -> DataFrame:
    """Rows of a left join, and how many found nothing."""
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("missing"))


# ---------------------------------------------------------------- as of


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: list[str], fallback: DataFrame | None = None) -> DataFrame:
    """Each left row with the columns of the latest right row not after it.

    Union and running last value, slice of time by slice: no range join, and keys
    of any size. Both times must be of one type; equal times match. A row without
    a match takes the ``columns`` of its key in ``fallback``, one row for each
    key, where that is given; its ``matched_at`` stays null.
    """
    names = [c for c in left.columns if c != key]
    both = left.select(key, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(_type(right, right_ts, columns)).alias("_new")).unionByName(
        right.select(key, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(F.col(right_ts).alias("matched_at"), *columns).alias("_new"))
    )
    out = dedup.carry_forward(both, key, [F.col("_t"), F.col("_side")], ["_new"]).filter("_side = 1")
    if fallback is None:
        return out.select(key, "_row.*", "last__new.*")
    own = fallback.select(key, *(F.col(c).alias(f"_own_{c}") for c in columns), F.lit(True).alias("_own"))
    filled = [F.when(F.col("last__new").isNotNull(), F.col(f"last__new.{c}")).otherwise(F.col(f"_own_{c}")).alias(c) for c in columns]
    return out.join(own, key, "left").select(key, "_row.*", "last__new.matched_at", *filled)


def _type(right: DataFrame, right_ts: str, columns: list[str]) -> str:
    return right.select(F.struct(F.col(right_ts).alias("matched_at"), *columns).alias("x")).schema["x"].dataType.simpleString()


# ---------------------------------------------------------------- containing

GRAM = 3


def containing(needles: DataFrame, needle: str, hay: DataFrame, text: str) -> DataFrame:
    """Pairs in which ``text`` contains ``needle``, both compared as they are.

    An equality join on the needle's first three signs with all such runs of the
    text, then the full test: no nested loop. Empty needles match nothing.
    """
    n = F.length(text)
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    grams = F.array_distinct(F.concat(*(runs(k) for k in range(1, GRAM + 1))))
    left = needles.filter(F.col(needle) != "").withColumn("_gram", F.left(F.col(needle), F.lit(GRAM)))
    return left.join(hay.withColumn("_gram", F.explode(grams)), "_gram").filter(F.contains(F.col(text), F.col(needle))).drop("_gram")


def multiplier_by_containment(symbols: DataFrame, catalog: DataFrame, default: float = 1.0) -> DataFrame:
    """Highest multiplier among catalog industries that contain the symbol's.

    Distinct industries meet the catalog, not each symbol; null and empty ones
    get the default.
    """
    wanted = symbols.select("industry").filter("industry <> ''").distinct().withColumn("_needle", F.lower("industry"))
    entries = catalog.groupBy(F.lower("industry_name").alias("_text")).agg(F.max("multiplier").alias("multiplier"))
    found = containing(wanted, "_needle", entries, "_text").groupBy("industry").agg(F.max("multiplier").alias("macro_multiplier"))
    return symbols.join(found, "industry", "left").withColumn("macro_multiplier", F.coalesce("macro_multiplier", F.lit(default)))


def macro_row_for(symbols: DataFrame, catalog: DataFrame, default: float = 1.0) -> DataFrame:
    """As ``multiplier_by_containment``, with ``macro_rationale``, ``macro_sector`` and ``macro_industry`` of the highest row.

    ``catalog`` has ``sector_name, industry_name, multiplier, rationale``; of equal
    multipliers the first sector and industry by name count.
    """
    wanted = symbols.select("industry").filter("industry <> ''").distinct().withColumn("_needle", F.lower("industry"))
    rationale = F.col("rationale") if "rationale" in catalog.columns else F.lit(None).cast("string")
    # sorted by what counts, the first is the least
    row = F.struct((-F.col("multiplier")).alias("low"), "sector_name", "industry_name", rationale.alias("rationale"))
    entries = catalog.filter("multiplier IS NOT NULL").groupBy(F.lower("industry_name").alias("_text")).agg(F.min(row).alias("_row"))
    found = containing(wanted, "_needle", entries, "_text").groupBy("industry").agg(F.min("_row").alias("_best"))
    best = F.col("_best")
    return symbols.join(found, "industry", "left").withColumns(
        {"macro_multiplier": F.coalesce(-best["low"], F.lit(default)), "macro_rationale": best["rationale"], "macro_sector": best["sector_name"], "macro_industry": best["industry_name"]}
    ).drop("_best")


def cascading_multiplier(picks: DataFrame, catalog: DataFrame, default: float = 1.0) -> DataFrame:
    """By sector and industry; else the highest of sectors that contain the pick's; else the default."""
    exact = catalog.groupBy(F.lower("sector_name").alias("_s"), F.lower("industry_name").alias("_i")).agg(F.max("multiplier").alias("_m1"))
    sectors = exact.groupBy("_s").agg(F.max("_m1").alias("_m2")).withColumnRenamed("_s", "_text")
    wanted = picks.select(F.lower("sector").alias("_s2")).filter("_s2 <> ''").distinct()
    sector = containing(wanted, "_s2", sectors, "_text").groupBy("_s2").agg(F.max("_m2").alias("_m2"))
    return (
        picks.join(exact, (F.lower("sector") == F.col("_s")) & (F.lower("pick") == F.col("_i")), "left")
        .join(sector, F.lower("sector") == F.col("_s2"), "left")
        .withColumn("multiplier", F.coalesce("_m1", "_m2", F.lit(default))).drop("_s", "_i", "_m1", "_s2", "_m2")
    )


_SEPARATOR = r"\s*[|/>:,-]\s*"


def _bare(pick: Column) -> Column:
    """A pick without index and quotes, in lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.trim(pick), r"^\[\d+\]\s*", ""), F.lit(" \t\r\n\"'")))


def snap_to_catalog(picks: DataFrame, catalog: DataFrame, pick: str = "pick") -> DataFrame:
    """The catalog entry "sector | industry" that a free-text pick means, or an empty string.

    Exact text first, then with its first separator made alike, then both
    parts, then the industry alone; then the longest industry that contains the
    pick's, then the longest of sectors that contain the pick's sector. A pick
    without a separator serves as sector and industry. Ties go by name.
    """
    entry = catalog.select(
        F.lower("sector_name").alias("_s"), F.lower("industry_name").alias("_i"), F.length("industry_name").alias("_n"), F.concat_ws(" | ", "sector_name", "industry_name").alias("entry")
    ).distinct()
    parts = F.split("_bare", _SEPARATOR, 2)
    distinct = picks.select(F.col(pick).alias("_pick")).distinct().withColumn("_bare", _bare(F.col("_pick")))
    distinct = distinct.withColumns({"_sector": F.trim(F.get(parts, F.lit(0))), "_industry": F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))})
    distinct = distinct.withColumns({"_needle": F.coalesce(F.nullif("_industry", F.lit("")), "_sector"), "_alike": F.when(F.size(parts) > 1, F.concat_ws(" | ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))})
    whole = F.lower("entry")
    hit = lambda df, rank: df.select("_pick", F.lit(rank).alias("_rank"), "_n", "entry")
    exact = [
        hit(distinct.join(entry, F.col("_bare") == whole), 0),
        hit(distinct.join(entry, F.col("_alike") == whole), 1),
        hit(distinct.join(entry, (F.col("_sector") == F.col("_s")) & (F.col("_industry") == F.col("_i"))), 2),
        hit(distinct.join(entry, (F.col("_needle") == F.col("_i")) & (F.col("_needle") != "")), 3),
    ]
    loose = [hit(containing(distinct, "_needle", entry, "_i"), 4), hit(containing(distinct, "_sector", entry, "_s"), 5)]
    hits = exact[0]
    for more in exact[1:] + loose:
        hits = hits.unionByName(more)
    order = F.struct("_rank", F.when(F.col("_rank") >= 4, -F.col("_n")).otherwise(F.lit(0)), "entry")
    best = hits.groupBy("_pick").agg(F.min_by("entry", order).alias("snapped"))
    return picks.join(best, picks[pick] == best["_pick"], "left").drop("_pick").withColumn("snapped", F.coalesce("snapped", F.lit("")))


def sector_snap(picks: DataFrame, sectors: DataFrame, pick: str = "pick") -> DataFrame:
    """The sector that a pick means: equal but for case, else the first by name
    of those that contain it or that it contains; else an empty string."""
    names = sectors.select("sector_name").distinct().withColumn("_s", F.lower("sector_name"))
    best = _either_way(picks, pick, names, "_s", "sector_name", longest=False)
    return picks.join(best, picks[pick] == best["_pick"], "left").drop("_pick").withColumn("snapped", F.coalesce("snapped", F.lit("")))


def industry_snap(picks: DataFrame, catalog: DataFrame, pick: str = "pick", sector: str = "sector") -> DataFrame:
    """The industry of the pick's sector that it means, as "sector | industry".

    Equal but for case, else the longest of those that contain it or that it
    contains, else the sector's shortest; an empty string for an unknown sector.
    """
    names = catalog.select(F.col("sector_name").alias("_of"), "industry_name").distinct().withColumn("_i", F.lower("industry_name"))
    best = _either_way(picks, pick, names, "_i", "industry_name", longest=True, within=(sector, "_of"))
    shortest = names.groupBy("_of").agg(F.min_by("industry_name", F.struct(F.length("industry_name"), "industry_name")).alias("_least"))
    out = picks.join(best, (picks[pick] == best["_pick"]) & (picks[sector] == best["_within"]), "left").drop("_pick", "_within").join(shortest, F.col(sector) == F.col("_of"), "left")
    return out.withColumn("snapped", F.coalesce(F.concat_ws(" | ", sector, F.coalesce("snapped", "_least")), F.lit(""))).withColumn(
        "snapped", F.when(F.col("_least").isNull(), "").otherwise(F.col("snapped"))
    ).drop("_of", "_least")


def _either_way(picks: DataFrame, pick: str, names: DataFrame, low: str, name: str, *, longest: bool, within: tuple[str, str] | None = None) -> DataFrame:
    keys = [F.col(within[0]).alias("_within")] if within else [F.lit("").alias("_within")]
    wanted = picks.select(F.col(pick).alias("_pick"), *keys).distinct().withColumn("_bare", _bare(F.col("_pick"))).filter("_bare <> ''")
    own = names.withColumn("_group", F.col(within[1]) if within else F.lit(""))
    same = F.col("_within") == F.col("_group")
    hit = lambda df, rank: df.filter(same).select("_pick", "_within", F.lit(rank).alias("_rank"), F.col(name).alias("_name"))
    hits = (
        hit(wanted.join(own, F.col("_bare") == F.col(low)), 0)
        .unionByName(hit(containing(wanted, "_bare", own, low), 1)).unionByName(hit(containing(own, low, wanted, "_bare"), 1))
    )
    size = -F.length("_name") if longest else F.lit(0)
    best = hits.groupBy("_pick", "_within").agg(F.min_by("_name", F.struct("_rank", F.when(F.col("_rank") == 1, size).otherwise(F.lit(0)), "_name")).alias("snapped"))
    return best if within else best.drop("_within")


def related_research(symbols: DataFrame, catalog: DataFrame, research: DataFrame, n: int = 8, newest: int = 5) -> DataFrame:
    """Research that names a symbol's sector or one of the sector's industries as whole words.

    Keywords are the symbol's sector and the industries of all catalog sectors
    that contain it, of three letters and more. A symbol without a match gets
    what names its sector alone; one without keywords the newest ``newest``.
    Each gets its newest ``n``. Ids of articles meet distinct keywords by their
    first words; an article's text then meets, once, the keywords it may hold.
    """
    sectors = symbols.select("sector").filter("length(sector) > 2").distinct().withColumn("_needle", F.lower("sector"))
    entries = catalog.select(F.lower("sector_name").alias("_text"), "industry_name").distinct()
    keywords = containing(sectors, "_needle", entries, "_text").select("sector", F.col("industry_name").alias("keyword")).unionByName(sectors.select("sector", F.col("sector").alias("keyword")))
    keywords = keywords.filter("length(keyword) > 2").distinct()
    text = F.concat_ws("\n", "title", "summary")
    articles = research.filter("llm_processed").select("id", "published_at", text.alias("_text"))
    # a keyword's first word must be a word of the article; then the whole keyword is tested
    first = F.lower(F.regexp_extract("keyword", r"\w+", 0))
    words = F.array_distinct(F.filter(F.split(F.lower("_text"), r"\W+"), lambda w: w != ""))
    spoken = keywords.select("keyword").distinct().withColumn("_word", first)
    likely = articles.select("id", F.explode(words).alias("_word")).join(spoken, "_word").groupBy("id").agg(F.collect_set("keyword").alias("_likely"))
    told = F.filter("_likely", lambda k: has_word(F.col("_text"), k))
    found = articles.join(likely, "id").select("id", "published_at", F.explode(told).alias("keyword"))
    order = [F.desc("published_at"), F.desc("id")]
    by_sector = newest_n(found.join(keywords, "keyword").select("sector", "id", "published_at").distinct(), "sector", n, order)
    own = symbols.select(F.col("id").alias("symbol_id"), "sector")
    matched = own.join(by_sector, "sector").select("symbol_id", "id", "published_at")
    latest = articles.orderBy(*order).limit(newest).select(F.struct("id", "published_at").alias("a")).agg(F.collect_list("a")).scalar()
    unkeyed = own.filter("sector IS NULL OR length(sector) <= 2").select("symbol_id", F.explode(latest).alias("a"))
    return matched.unionByName(unkeyed.select("symbol_id", "a.id", "a.published_at"))


# ---------------------------------------------------------------- reconciling


def reconcile(live: DataFrame, stored: DataFrame, key: str, name: str, active: str) -> DataFrame:
    """What a live universe does to the stored one: an action for each key."""
    a = live.select(key, F.col(name).alias("_live"), F.lit(True).alias("_in_live"))
    b = stored.select(key, F.col(name).alias("_stored"), F.col(active).alias("_active"), F.lit(True).alias("_in_stored"))
    action = (
        F.when(F.col("_in_stored").isNull(), "new").when(F.col("_in_live").isNull() & F.col("_active"), "delisted").when(F.col("_in_live").isNull(), "unchanged")
        .when(~F.col("_active"), "restored").otherwise("unchanged")
    )
    return a.join(b, key, "full_outer").select(key, F.coalesce("_live", "_stored").alias(name), action.alias("action"))


def added(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return live.select(key).subtract(stored.select(key))


def removed(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return stored.select(key).subtract(live.select(key))


def kept(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return live.select(key).intersect(stored.select(key))


def distinct_union(*named: DataFrame) -> DataFrame:
    """The distinct values of one-column tables, under the first one's name."""
    out = named[0]
    for more in named[1:]:
        out = out.union(more)
    return out.distinct()


def with_flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Whether ``other`` has the key, as a column."""
    return df.join(other.select(key).distinct().withColumn("_has", F.lit(True)), key, "left").withColumn(name, F.col("_has").isNotNull()).drop("_has")


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """``fallback`` rows only for keys without a primary row."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def union_priority(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both tables; on a clash of keys the first one's rows."""
    return with_fallback(first, second, key)


def form_assignment(symbols: DataFrame, registry: list, with_feed: DataFrame) -> DataFrame:
    """Forms to fetch: some for every active symbol, the others where no feed is.

    ``registry`` lists rows with ``form`` and ``all_symbols``; it is a literal of
    the plan, so nothing is joined with it.
    """
    active = symbols.filter("status").select("id")
    lonely = active.join(with_feed.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_anti")
    forms = lambda everyone: F.explode(F.array(*(F.lit(r.form) for r in registry if r.all_symbols == everyone)).cast("array<string>")).alias("form")
    return active.select("id", forms(True)).unionByName(lonely.select("id", forms(False)))


def lonely_symbols(symbols: DataFrame, with_feed: DataFrame) -> DataFrame:
    """Active symbols, and as ``lonely`` whether no feed is there; one row each, where ``form_assignment`` gives one a form."""
    fed = with_feed.select(F.col("symbol_id").alias("id")).distinct().withColumn("_fed", F.lit(True))
    return symbols.filter("status").join(fed, "id", "left").withColumn("lonely", F.col("_fed").isNull()).drop("_fed")


def resolve(exploded: DataFrame, symbols: DataFrame, ticker: str, name: str) -> DataFrame:
    """Tickers to active symbols; unmatched ones go, one id for each ticker."""
    known = symbols.filter("status").groupBy(F.upper(name).alias("_ticker")).agg(F.min("id").alias("symbol_id"))
    return exploded.join(known, F.upper(ticker) == F.col("_ticker")).drop("_ticker")

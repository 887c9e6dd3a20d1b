"""Aggregations over scored articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .dedup import compact_ranks, newest_n


def decayed_mean(df: DataFrame, key: str, score: str, ts: str, as_of: Column, *, least: float = scoring.MATERIAL, weight: Column | None = None) -> DataFrame:
    """Weighted mean of material scores by key, and the newest of them; rows without a time do not count."""
    w = scoring.decay_weight(ts, as_of)
    w = w * weight if weight is not None else w
    kept = df.filter(scoring.material(score, least) & F.col(ts).isNotNull()).select(key, F.col(score).alias("_s"), w.alias("_w"), F.col(ts).alias("_t"))
    return kept.groupBy(key).agg(
        F.try_divide(F.sum(F.col("_s") * F.col("_w")), F.sum("_w")).alias("mean_score"), F.max("_t").alias("newest"), F.count("*").alias("n_material")
    )


def sec_modifier(signals: DataFrame, symbols: DataFrame, as_of: Column, *, days: int = 180, most: float = 0.2, late: float = 0.06) -> DataFrame:
    """``symbol_id, sec_modifier`` of every symbol: recent signals, less a penalty for a late annual report.

    ``symbols`` has ``id, last_10k_filed``: missing, or over 18 months old, it
    costs ``late``.
    """
    recent = signals.filter("is_active") if "is_active" in signals.columns else signals
    recent = recent.filter(F.col("filed_at") > as_of - F.expr(f"INTERVAL {days} DAYS")).groupBy("symbol_id").agg(F.sum(F.col("modifier").cast("decimal(18,6)")).alias("_sum"))
    overdue = F.coalesce(scoring.age_days("last_10k_filed", as_of) > 18 * scoring.DAYS_PER_MONTH, F.lit(True))
    total = F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)) - F.when(overdue, late).otherwise(0.0)
    rows = symbols.select(F.col("id").alias("symbol_id"), "last_10k_filed").join(recent, "symbol_id", "left")
    return rows.select("symbol_id", F.round(scoring.clamp(total, -most, most), 4).alias("sec_modifier"))


#: Families of filings; the first prefix that fits counts. Fixed values.
FAMILIES = (
    ("10-K", ("10-K",)), ("10-Q", ("10-Q",)), ("8-K", ("8-K",)), ("4", ("4",)), ("13D", ("SC 13D",)), ("13G", ("SC 13G",)), ("S-3", ("S-3", "424B")), ("NT", ("NT",)),
)
#: Families of which only the form itself and its amendment count, not all that begins so.
WHOLE = {"8-K": ("8-K", "8-K/A"), "4": ("4",)}


def family(form: Column | str) -> Column:
    """The family of a form: ``news`` for none, ``other`` where no family fits."""
    f = F.col(form) if isinstance(form, str) else form
    out = F.lit("other")
    for name, prefixes in reversed(FAMILIES):
        fits = f.isin(*WHOLE[name]) if name in WHOLE else F.lit(False)
        for prefix in () if name in WHOLE else prefixes:
            fits = fits | f.startswith(prefix)
        out = F.when(fits, name).otherwise(out)
    return F.when(f.isNull(), "news").otherwise(out)


def family_counts(df: DataFrame, key: str, form: str) -> DataFrame:
    """Articles of each key by family, one column each: ``n_news``, ``n_10k``, and so on."""
    kinds = ["news", *(name for name, _ in FAMILIES), "other"]
    f = family(form)
    return df.groupBy(key).agg(*(F.count_if(f == k).alias("n_" + k.lower().replace("-", "")) for k in kinds))


def exact_mean(value: Column | str, places: int = 4) -> Column:
    """Mean of values of six decimals, rounded half up: the same for any order of rows."""
    v = F.col(value) if isinstance(value, str) else value
    micros, n = (F.sum(v.cast("decimal(18,6)")) * F.lit(1_000_000)).cast("long"), F.count(v)
    unit = 10 ** (6 - places)
    parts = F.floor((2 * F.abs(micros) + unit * n) / (2 * unit * n)).cast("double")
    return F.when(n > 0, F.when(micros < 0, -parts).otherwise(parts) / F.lit(float(10**places)))


def score_composition(articles: DataFrame, key: str = "symbol_id", score: str = "score", n: int = 50) -> DataFrame:
    """Mean score of the newest ``n`` scored articles by source: news, annual, quarterly and event reports."""
    newest = newest_n(articles.filter(F.col(score).isNotNull()), key, n, [F.desc("published_at"), F.desc("id")])
    f = family("form_type")
    parts = (("news", "news"), ("10-K", "annual"), ("10-Q", "quarterly"), ("8-K", "events"))
    return newest.groupBy(key).agg(*(F.coalesce(exact_mean(F.when(f == k, F.col(score))), F.lit(0.0)).alias(name) for k, name in parts))


def leaderboard_stats(df: DataFrame, score: str = "score", margin: float = 0.05) -> DataFrame:
    """One row: how many, mean, extremes, and how many lean either way."""
    s = F.col(score)
    return df.agg(
        F.count("*").alias("n"), exact_mean(s, 6).alias("mean"), F.max(s).alias("high"), F.min(s).alias("low"), F.count_if(s > margin).alias("bullish"), F.count_if(s < -margin).alias("bearish")
    )


def feed_counts(feeds: DataFrame, key: str = "symbol_id") -> DataFrame:
    """Distinct feeds of each key, active ones and all."""
    return feeds.groupBy(key).agg(F.countDistinct(F.when(F.col("is_active"), F.col("id"))).alias("active"), F.countDistinct("id").alias("total"))


def source_weighted_mean(df: DataFrame, key: str, score: str, ts: str, weight: Column, as_of: Column) -> DataFrame:
    """As ``decayed_mean``, each article also weighted by its source."""
    return decayed_mean(df, key, score, ts, as_of, weight=weight)


def legacy_mean(df: DataFrame, key: str, score: str, ts: str, as_of: Column) -> DataFrame:
    """Plain mean of decayed scores, where weights sum to nothing."""
    return df.groupBy(key).agg(F.avg(F.col(score) * scoring.decay_weight(ts, as_of)).alias("mean_score"))


def newest_material(df: DataFrame, key: str, score: str, ts: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.when(scoring.material(score), F.col(ts))).alias("newest"))


def tier1_coverage_guard(articles: DataFrame, key: str = "symbol_id", score: str = "score", forms: tuple[str, ...] = ("10-K", "10-K/A", "10-Q", "10-Q/A")) -> DataFrame:
    """Core filings of each key and their amendments, scored ones, and whether none is: then no score is given."""
    core = articles.filter(F.col("form_type").isin(*forms)).groupBy(key)
    return core.agg(F.count("*").alias("total"), F.count(score).alias("scored"), (F.count(score) == 0).alias("blocked"))


def unscored_worklist(articles: DataFrame, key: str = "symbol_id", score: str = "score") -> DataFrame:
    return articles.groupBy(key).agg(F.count_if(F.col(score).isNull()).alias("unscored")).filter("unscored > 0")


def feed_article_counts(feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """Every feed with its number of articles; articles are counted before the join."""
    n = articles.groupBy(F.col("feed_id").alias("id")).agg(F.count("*").alias("article_count"))
    return feeds.join(n, "id", "left").na.fill(0, ["article_count"])


def host(url: Column | str) -> Column:
    return F.regexp_extract(url, "^[A-Za-z]+://([^/?#]+)", 1)


def top_hosts(df: DataFrame, url: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent hosts."""
    return df.groupBy(host(url).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(k)


def zero_article_domains(feeds: DataFrame, articles: DataFrame, k: int = 20) -> DataFrame:
    """Hosts of feeds that never gave an article, the most frequent first."""
    silent = feeds.join(articles.select(F.col("feed_id").alias("id")), "id", "left_anti")
    return top_hosts(silent, "feed_url", k)


def source_profile(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Rows by source with the range of a measure, such as a date."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(measure).alias("lowest"), F.max(measure).alias("highest"))


def coverage_heatmap(filings: DataFrame, as_of: Column, form: str = "form_type", ts: str = "published_at", keys: tuple[str, ...] = ()) -> DataFrame:
    """Filings by form and months of 30 days since."""
    months = F.floor(scoring.age_days(ts, as_of) / 30).alias("months")
    return filings.filter(F.col(form).isNotNull()).groupBy(*keys, form, months).agg(F.count("*").alias("n"))


def connection_sets(pairs: DataFrame, key: str, names: str) -> DataFrame:
    """Distinct trimmed, non-empty names of each key; ``names`` may be text or a list."""
    listed = dict(pairs.dtypes)[names].startswith("array")
    rows = pairs.select(key, F.explode(names).alias("name")) if listed else pairs.select(key, F.col(names).alias("name"))
    return rows.select(key, F.trim("name").alias("name")).filter("name <> ''").distinct()


def insider_totals(trades: DataFrame, key: str, *, code: str = "code", shares: str = "shares", price: str = "price") -> DataFrame:
    """Value bought (code P) and sold (S), and the number of trades."""
    value = F.col(shares) * F.col(price)
    total = lambda c: F.sum(F.when(F.col(code) == c, value).otherwise(0.0))
    return trades.groupBy(key).agg(total("P").alias("bought"), total("S").alias("sold"), F.count("*").alias("n"))


def run_summary(inserted: DataFrame, form: str = "form_type") -> DataFrame:
    """Rows inserted by form, and in all as ``total``."""
    rolled = inserted.filter(F.col(form).isNotNull()).rollup(form).agg(F.count("*").alias("n"), F.grouping(form).alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, "total").otherwise(F.col(form)).alias("form"), "n")


def max_multiplier_per_sector(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("sector_name").agg(F.coalesce(F.max("multiplier"), F.lit(1.0)).alias("multiplier"))


def ordered_ids(df: DataFrame, key: str, ts: str, id_col: str = "id") -> DataFrame:
    """The ids of each key in order, newest first, one row each; place 1 is the keeper.

    Rows, not one array per key: a key of any size is ranked slice by slice.
    """
    epoch = df.select(key, id_col, (-F.unix_micros(F.col(ts).cast("timestamp"))).alias("_newest"))
    ranked = compact_ranks(epoch, "_newest", [id_col], key)
    return ranked.select(key, id_col, F.col("compact_rank").alias("place"), (F.col("compact_rank") == 1).alias("keeper"))


def throughput(events: DataFrame, kind: str, ts: str, id_col: str, as_of: Column, *, most: int = 200, hours: int = 24) -> DataFrame:
    """Rate per hour of the newest events of each kind in the last hours."""
    recent = events.filter((F.col(ts) > as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= as_of))
    newest = newest_n(recent, kind, most, [F.desc(ts), F.desc(id_col)])
    n = F.count("*")
    span = F.greatest(F.lit(30.0), (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6)
    return newest.groupBy(kind).agg(n.alias("n"), F.when(n >= 2, F.round(n / (span / 3600), 6)).alias("per_hour"), F.least(F.lit(1.0), n / most).alias("confidence"))


def leaderboard(symbols: DataFrame, articles: DataFrame) -> DataFrame:
    """Every symbol with its scored and all articles, mean score and label."""
    counts = articles.groupBy(F.col("symbol_id").alias("id")).agg(F.count("score").alias("n_scored"), F.count("*").alias("n_total"), exact_mean("score", 6).alias("avg_score"))
    return symbols.join(counts, "id", "left").select(
        "id", "company_name", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), F.coalesce("n_total", F.lit(0)).alias("n_total"),
        "avg_score", scoring.score_label("avg_score").alias("label"),
    )


def top_k(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The ``k`` most common values of each key; ties by value."""
    counted = df.filter(F.trim(value) != "").groupBy(key, value).agg(F.count("*").alias("n"))
    return newest_n(counted, key, k, [F.desc("n"), F.col(value)])

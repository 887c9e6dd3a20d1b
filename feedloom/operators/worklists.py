"""Sorted lists: leaderboards, pages, worklists, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

#: Columns by which a leaderboard may be sorted; others fall back to the first.
SORTABLE = ("final_score", "company_name", "n_scored", "n_total", "macro_multiplier")


def sort_leaderboard(df: DataFrame, column: str, *, descending: bool = True, allowed: tuple[str, ...] = SORTABLE, tie: str = "id") -> DataFrame:
    """Sorted by an allowed column, nulls last; by the first of them if it is not allowed."""
    c = F.col(column if column in allowed else allowed[0])
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in a total order."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def shuffle_key(id_col: str, day: Column) -> Column:
    """A key that is stable within a day and another on the next."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), day.cast("date").cast("string")).cast("binary"))


def daily_shuffle(df: DataFrame, day: Column, id_col: str = "id") -> DataFrame:
    return df.withColumn("shuffle_key", shuffle_key(id_col, day)).orderBy("shuffle_key", id_col)


def worklist(symbols: DataFrame, active: DataFrame, queue: DataFrame, day: Column, pending: int = 50) -> DataFrame:
    """What to score: in work (longest first), then queued by rank, then some of the rest.

    ``active`` has ``id, elapsed``, ``queue`` has ``id, rank``. Of the rest, in
    the day's shuffled order, ``pending`` come in. ``tier`` is 0, 1 or 2.
    """
    tiered = symbols.join(active.select("id", "elapsed"), "id", "left").join(queue.select("id", "rank"), "id", "left")
    tier = F.when(F.col("elapsed").isNotNull(), 0).when(F.col("rank").isNotNull(), 1).otherwise(2)
    tiered = tiered.withColumns({"tier": tier, "shuffle_key": shuffle_key("id", day)})
    rest = tiered.filter("tier = 2").orderBy("shuffle_key", "id").limit(pending)
    shown = tiered.filter("tier < 2").unionByName(rest)
    by_tier = F.when(F.col("tier") == 0, -F.col("elapsed").cast("double")).when(F.col("tier") == 1, F.col("rank").cast("double"))
    return shown.orderBy("tier", by_tier, F.when(F.col("tier") == 2, F.col("shuffle_key")), "id")


def capped_worklist(symbols: DataFrame, queue: DataFrame, limit: int, day: Column) -> DataFrame:
    """Queued symbols by rank, then the others in the day's order, ``limit`` in all."""
    ranked = symbols.join(queue.select("id", "rank"), "id", "left").withColumn("shuffle_key", shuffle_key("id", day))
    return ranked.orderBy(F.col("rank").asc_nulls_last(), "shuffle_key", "id").limit(limit)


def score_swings(old: DataFrame, new: DataFrame, k: int = 20, *, key: str = "symbol_id", score: str = "score", least: float = 0.01) -> DataFrame:
    """The ``k`` largest moves beyond ``least`` between two tables of scores."""
    both = old.select(key, F.col(score).alias("old")).join(new.select(key, F.col(score).alias("new")), key)
    swing = F.abs(F.col("new") - F.col("old"))
    return both.withColumn("swing", swing).filter(F.col("swing") > least).orderBy(F.desc("swing"), key).limit(k)


def macro_ranking(catalog: DataFrame, k: int | None = None) -> DataFrame:
    """Entries by falling multiplier, with a bar of 0 to 100 for 1.00 to 1.05."""
    bar = scoring.clamp((F.col("multiplier") - 1) / 0.05 * 100 + 1e-9, 0.0, 100.0).cast("int")
    ranked = catalog.orderBy(F.desc("multiplier"), "sector_name", "industry_name")
    return (ranked if k is None else ranked.limit(k)).withColumn("bar", bar)


def symbol_articles(articles: DataFrame, n: int = 200, *, score: str = "score", ts: str = "published_at", id_col: str = "id") -> DataFrame:
    """Unscored first, then newest, ``n`` at most."""
    return articles.orderBy(F.col(score).isNotNull(), F.col(ts).desc_nulls_last(), id_col).limit(n)

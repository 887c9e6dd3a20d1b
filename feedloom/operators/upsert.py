"""Writes as pure functions of the stored table and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ci
from .dedup import keep_first


def append_new(target: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``target`` and the batch's rows of unseen keys, one for each key."""
    return target.unionByName(keep_first(batch, [key], order).join(target.select(key), key, "left_anti"))


def split_known(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The batch with whether its key is stored already."""
    return batch.join(target.select(key).distinct().withColumn("_k", F.lit(True)), key, "left").withColumn("known", F.col("_k").isNotNull()).drop("_k")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch's rows replace stored ones of equal keys; others join."""
    return target.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(keep_first(batch, keys, order))


def keep_longer(target: DataFrame, batch: DataFrame, keys: list[str], text: str, stamped: list[str]) -> DataFrame:
    """Stamp columns of the batch, and keep the longer of both texts."""
    new = batch.select(*keys, F.col(text).alias("_text"), *(F.col(c).alias(f"_{c}") for c in stamped), F.lit(True).alias("_new"))
    longer = F.when(F.coalesce(F.length("_text"), F.lit(-1)) > F.coalesce(F.length(text), F.lit(-1)), F.col("_text")).otherwise(F.col(text))
    stamps = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in stamped]
    return target.join(new, keys, "full_outer").select(*keys, longer.alias(text), *stamps)


def raise_multiplier(target: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """Never lower; the rationale of the highest, latest signal from the old on."""
    top = signals.groupBy(*keys).agg(F.max("multiplier").alias("_m"), F.max_by("rationale", F.struct("multiplier", "seq")).alias("_r"))
    return target.join(top, keys, "left").select(
        *keys,
        F.greatest("multiplier", "_m").alias("multiplier"),
        F.when(F.col("_m") >= F.col("multiplier"), F.col("_r")).otherwise(F.col("rationale")).alias("rationale"),
    )


def patch_non_null(target: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite only where the new value is not null."""
    new = batch.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return target.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def advance_date(target: DataFrame, batch: DataFrame, key: str, date: str) -> DataFrame:
    """The date of a key only moves forward."""
    new = batch.groupBy(key).agg(F.max(date).alias("_d"))
    return target.join(new, key, "left").withColumn(date, F.greatest(date, "_d")).drop("_d")


def reset_where(df: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.coalesce(condition, F.lit(False)), F.col(c)) for c in columns})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; null keeps the row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


#: Addresses of pages that no feed reader can take, whatever they were filed as. Fixed values.
HTML_PAGES = ("nasdaq.com/market-activity", "yahoo.com/quote")


def retype_feeds(feeds: DataFrame, url: str = "feed_url", kind: str = "feed_type") -> DataFrame:
    """Feeds filed as ``rss`` whose address is that of a page become ``html``."""
    page = F.lit(False)
    for part in HTML_PAGES:
        page = page | contains_ci(url, part)
    return feeds.withColumn(kind, F.when(page & (F.col(kind) == "rss"), "html").otherwise(F.col(kind)))


def mark_processed(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, key, "left").withColumn(flag, F.coalesce("_hit", flag)).drop("_hit")


def touch_checked(feeds: DataFrame, batch: DataFrame, key: str, column: str, as_of: Column) -> DataFrame:
    hit = batch.select(key).distinct().withColumn("_hit", F.lit(True))
    return feeds.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), as_of).otherwise(F.col(column))).drop("_hit")


def run_audit(df: DataFrame, step: str, as_of: Column, failed: Column) -> DataFrame:
    """One row for a run: its counts, and a status that follows the outcome."""
    n, bad = F.count("*"), F.count_if(failed)
    status = F.when(bad == 0, "success").when(bad == n, "failed").otherwise("partial")
    return df.agg(n.alias("n_rows"), bad.alias("n_failed"), status.alias("status")).select(F.lit(step).alias("step"), as_of.alias("finished_at"), "n_rows", "n_failed", "status")

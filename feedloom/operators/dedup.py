"""Deduplication and ranking by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``, which must be total."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def newest_n(df: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def mark_first(df: DataFrame, name: str, keys: list[Column | str], order: list[Column], among: str | None = None) -> DataFrame:
    """Add whether a row is the one that ``keep_first`` would keep, of all rows or of those marked ``among``."""
    if among is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
    return df.withColumn(name, F.col(among) & (F.row_number().over(Window.partitionBy(among, *keys).orderBy(*order)) == 1))


def title_keys(key: str, title: str) -> list[Column | str]:
    """A title, whatever its case and outer spaces."""
    return [key, F.lower(F.trim(F.coalesce(title, F.lit(""))))]


def dedup_titles(df: DataFrame, key: str, title: str, order: list[Column]) -> DataFrame:
    """One row per key and title, whatever its case and outer spaces."""
    return keep_first(df, title_keys(key, title), order)


def variant_keys(key: str, ts: str, source: str) -> list[Column | str]:
    """Five minutes of a source; rows without a time are variants of each other."""
    return [key, F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 300), source]


def variant_order(score: str, english: Column | None = None, id_col: str = "id") -> list[Column]:
    """Scored first, then English, then score."""
    return [F.col(score).isNull(), *([~english] if english is not None else []), F.coalesce(score, F.lit(-99.0)).desc(), F.col(id_col)]


def dedup_language_variants(df: DataFrame, key: str, ts: str, source: str, score: str, english: Column | None = None, id_col: str = "id") -> DataFrame:
    """One row per key, five minutes and source: scored first, then English, then score."""
    return keep_first(df, variant_keys(key, ts, source), variant_order(score, english, id_col))


def duplicate_groups(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


#: Widths of the slices in which a key's rows are scanned: a day of times, so many of numbers, signs of texts.
SLICE_SECONDS, SLICE_NUMBERS, SLICE_SIGNS = 86_400, 256, 2


def slice_of(df: DataFrame, value: Column) -> Column:
    """A coarser value in the same order, for the type of ``value``."""
    kind = df.select(value).schema[0].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.floor(F.unix_seconds(value.cast("timestamp")) / SLICE_SECONDS)
    return F.left(value, F.lit(SLICE_SIGNS)) if isinstance(kind, StringType) else F.floor(value / SLICE_NUMBERS)


def _by_slices(df: DataFrame, key: str, order: list[Column], slice_by: Column | None, inside: dict[str, Column], ends: dict[str, Column]) -> DataFrame:
    """``inside`` over each key's slices, and as ``_before_<name>`` the last of ``ends`` over its earlier ones.

    A key's rows go to as many tasks as it has slices; only one summary for each
    slice is scanned by key, and joined back.
    """
    cut = df.withColumn("_slice", slice_of(df, order[0]) if slice_by is None else slice_by)
    scanned = cut.withColumns(inside)
    summaries = cut.groupBy(key, "_slice").agg(*(e.alias(name) for name, e in ends.items()))
    w = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = summaries.select(F.col(key).alias("_key"), F.col("_slice").alias("_at"), *(F.last(name, ignorenulls=True).over(w).alias(f"_before_{name}") for name in ends))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_slice").eqNullSafe(F.col("_at"))
    return scanned.join(before, same, "left").drop("_slice", "_key", "_at")


def carry_forward(df: DataFrame, key: str, order: list[Column], columns: list[str], slice_by: Column | None = None) -> DataFrame:
    """Last value that is not null so far, by key, as ``last_<column>``.

    ``order`` ascends, and is total; keys of any size are scanned slice by slice,
    by ``slice_by`` (a value in the order of the first column) or by ``slice_of``.
    """
    w = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = {f"_in_{c}": F.last(c, ignorenulls=True).over(w) for c in columns}
    ends = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))) for c in columns}
    out = _by_slices(df, key, order, slice_by, inside, ends)
    return out.withColumns({f"last_{c}": F.coalesce(f"_in_{c}", f"_before_{c}") for c in columns}).drop(*(f"{x}_{c}" for x in ("_in", "_before") for c in columns))


def previous_state(df: DataFrame, key: str, order: list[Column], columns: list[str], slice_by: Column | None = None) -> DataFrame:
    """Values of the row before, by key, as ``previous_<column>``; order and slices as for ``carry_forward``."""
    own = F.struct(*columns)
    inside = {"_in": F.lag(own).over(Window.partitionBy(key, "_slice").orderBy(*order))}
    out = _by_slices(df, key, order, slice_by, inside, {"row": F.max_by(own, F.struct(*order))})
    row = F.coalesce("_in", "_before_row")
    return out.withColumns({f"previous_{c}": row[c] for c in columns}).drop("_in", "_before_row")


def contribution_share(df: DataFrame, key: str, weight: str, least_total: float = 0.0) -> DataFrame:
    """Percent of the key's total absolute weight, which counts as ``least_total`` at least.

    Sums are grouped and joined back, so that no task buffers a whole key.
    """
    totals = df.groupBy(key).agg(F.sum(F.abs(weight)).alias("_total"))
    total = F.greatest(F.col("_total"), F.lit(least_total))
    same = F.col("_key").eqNullSafe(F.col(key))
    joined = df.join(totals.withColumnRenamed(key, "_key"), same)
    return joined.withColumn("share", F.when(total > 0, F.abs(weight) / total * 100).otherwise(0.0)).drop("_key", "_total")


#: Slices in which ``compact_ranks`` ranks a group.
SLICES = 256


def compact_ranks(df: DataFrame, by: str, ties: list[str], group: str | None = None, slices: int = SLICES) -> DataFrame:
    """Add ``compact_rank``: 1, 2, 3 within each group, by ``by`` and then ``ties``; nulls first.

    ``by`` is a number or a time. Its range is cut into slices of about equal
    size; rows are ranked within group and slice, and the sizes of earlier
    slices added. So a group of any size, or a table without groups, is spread
    over tasks.
    """
    place = F.col(by).cast("double")
    cuts = [x for x in (df.agg(F.percentile_approx(place, [i / slices for i in range(1, slices)], 10_000)).first()[0] or []) if x is not None]
    at = F.array_position(F.transform(F.lit(sorted(set(cuts)) or [0.0]), lambda c: place < c), True)
    slice_of = F.when(place.isNull(), F.lit(-1)).otherwise(F.when(at > 0, at).otherwise(F.lit(len(cuts) + 1)).cast("int"))
    keys = [group] if group else []
    cut = df.withColumn("_slice", slice_of)
    sizes = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias("_group") for k in keys), F.col("_slice").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(by, *ties)))
    same = F.col("_slice") == F.col("_at")
    same = same & F.col(group).eqNullSafe(F.col("_group")) if group else same
    return ranked.join(starts, same).withColumn("compact_rank", F.col("_before") + F.col("_rank")).drop("_slice", "_at", "_before", "_rank", "_group")


def move_to_front(queue: DataFrame, moved: DataFrame, now: Column) -> DataFrame:
    """``id, rank, added_at`` with the moved ids at the front, ranks made compact.

    Of several moved at once the smallest id comes first. Ties of rank go by the
    time they were added.
    """
    first = moved.select("id").distinct().withColumns({"rank": F.lit(0), "added_at": now})
    rest = queue.select("id", F.col("rank").cast("int").alias("rank"), "added_at").join(first.select("id"), "id", "left_anti")
    ranked = compact_ranks(rest.unionByName(first), "rank", ["added_at", "id"])
    return ranked.select("id", F.col("compact_rank").cast("int").alias("rank"), "added_at")


def append_rank(queue: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``id, rank, added_at`` with ids that are not queued yet behind the last, by id."""
    fresh = new.select("id").distinct().join(queue.select("id"), "id", "left_anti")
    last = queue.agg(F.coalesce(F.max("rank"), F.lit(0)).cast("int")).first()[0]
    added = compact_ranks(fresh, "id", []).select("id", (F.lit(last) + F.col("compact_rank")).cast("int").alias("rank"), now.alias("added_at"))
    return queue.select("id", F.col("rank").cast("int").alias("rank"), "added_at").unionByName(added)


def last_n_by_family(filings: DataFrame, n: int = 5, key: str = "symbol_id", family: Column | str = "form_type") -> DataFrame:
    """The last ``n`` filings of each key and family."""
    named = filings.withColumn("family", F.col(family) if isinstance(family, str) else family)
    w = Window.partitionBy(key, "family").orderBy(F.desc("published_at"), F.desc("id"))
    return named.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def quarter_label(ts: Column | str) -> Column:
    return F.concat(F.lit("Q"), F.quarter(ts), F.lit(" "), F.year(ts))


def quarter_series(figures: DataFrame, *, ts: str = "published_at", cash_flow: str = "operating_cash_flow", capex: str = "capex") -> DataFrame:
    """Add ``label`` (Q1 2024) and ``burn``: cash flow less capital spending, where that is known."""
    return figures.withColumns({"label": quarter_label(ts), "burn": F.col(cash_flow) - F.coalesce(capex, F.lit(0.0))})


def cap_per_form(df: DataFrame, keys: list[str], order: list[Column], most: int, seen: DataFrame, id_col: str) -> DataFrame:
    """The first ``most`` rows per key; what was seen before uses up the cap."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= most).drop("_rank").join(seen.select(id_col).distinct(), id_col, "left_anti")


def first_n_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of the ``n`` smallest distinct keys, without one global window."""
    keys = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi")

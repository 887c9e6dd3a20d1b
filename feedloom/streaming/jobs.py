"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import upsert
from .store import KeyedStore

#: Folders by key hash in a store that ``append_batches`` writes.
BUCKETS = 64


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    On one machine (tests) a session may name none; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed_stream(df: DataFrame, name: str, files: int = 4) -> DataFrame:
    """The rows as a stream, landed as files of which a batch takes ``files``."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def live_articles(stream: DataFrame, symbols: DataFrame) -> DataFrame:
    """Arrivals of active symbols, however old; ``append_batches`` drops what is stored."""
    return stream.join(symbols.filter("status").select(F.col("id").alias("symbol_id")), "symbol_id")


def bucket_dedup(stream: DataFrame, *, ts: str = "published_at", late: str = "10 minutes") -> DataFrame:
    """One article per symbol, source and five minutes: highest score, lowest id."""
    best = F.max_by("id", F.struct(F.coalesce("score", F.lit(-99.0)), -F.col("id")))
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "5 minutes").alias("w"), "symbol_id", "source_name").agg(best.alias("id")).select("symbol_id", "source_name", F.col("w.start").alias("bucket"), "id")


def throughput(stream: DataFrame, *, ts: str = "scored_at", late: str = "1 hour") -> DataFrame:
    """Events per kind in sliding windows of a day, every hour."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "24 hours", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n"))


def scored_rows(rows: DataFrame) -> DataFrame:
    """``symbol_id, id, at, score, summary`` of ``id, symbol_id, published_at, score, summary``; rows without a score or time do not count."""
    return rows.filter("score IS NOT NULL AND published_at IS NOT NULL").select(
        "symbol_id", F.col("id").cast("long").alias("id"), F.col("published_at").cast("timestamp").alias("at"), F.col("score").cast("double").alias("score"), F.col("summary").cast("string").alias("summary")
    )


_LAST = ("last_at", "last_id", "last_score", "last_summary")


def _head(rows: DataFrame, **sums: Column) -> DataFrame:
    """One row per symbol: the last values, and ``sums``."""
    last = F.struct("last_at", "last_id")
    return rows.groupBy("symbol_id").agg(*(v.alias(k) for k, v in sums.items()), *(F.max_by(c, last).alias(c) for c in _LAST))


def keep_state(stored: DataFrame | None, batch: DataFrame, *, rate: float = scoring.DECAY, grace_hours: float = scoring.DAYS_PER_MONTH * 24, reference: str = "2024-01-01", least: float = scoring.MATERIAL) -> DataFrame:
    """For a ``KeyedStore`` by symbol: a running fold whose mean can be read for any time from then on.

    ``batch`` is of ``scored_rows``. The state has a head per symbol (``at`` is
    null) with decayed sums of what is past its grace and the last values, and the
    sums by time of what is in it. A time stays open until the newest article seen
    is a whole grace later; then it is folded into the sums, which are relative to a
    fixed time and decay as a whole when they are read. Folding on arrival, not by
    event time, because a watermark would drop late articles; an article older than
    what is folded is folded at once.
    """
    material = F.abs("score") >= least
    named = batch.select("symbol_id", F.when(material, F.col("at")).alias("newest"), F.col("at").alias("last_at"), F.col("id").alias("last_id"), F.col("score").alias("last_score"), F.col("summary").alias("last_summary"))
    heads = _head(named, newest=F.max("newest")).withColumns({"folded_until": F.lit(None).cast("timestamp"), "weighted": F.lit(0.0), "weight": F.lit(0.0), "n_folded": F.lit(0).cast("long")})
    times = batch.filter(material).groupBy("symbol_id", "at").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    if stored is not None:
        known = stored.filter("at IS NULL").select(*heads.columns)
        heads = _head(known.unionByName(heads), **{c: F.max(c) for c in ("newest", "folded_until")}, **{c: F.sum(c) for c in ("weighted", "weight", "n_folded")})
        times = stored.filter("at IS NOT NULL").select(*times.columns).unionByName(times).groupBy("symbol_id", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    grace = int(round(grace_hours * 3.6e9))
    heads = heads.withColumn("folded_until", F.greatest("folded_until", F.timestamp_micros(F.unix_micros("newest") - grace)))
    limits = heads.select(F.col("symbol_id").alias("_symbol"), F.col("folded_until").alias("_until"))
    placed = times.join(limits, F.col("symbol_id") == F.col("_symbol")).drop("_symbol")
    w = F.exp(rate * ((F.unix_micros("at") - F.unix_micros(F.lit(reference).cast("timestamp")) + grace) / 3.6e9))
    past = placed.filter("at <= _until").groupBy(F.col("symbol_id").alias("_symbol")).agg(F.sum(F.col("total") * w).alias("_weighted"), F.sum(F.col("n") * w).alias("_weight"), F.sum("n").alias("_n_folded"))
    added = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("weighted", "weight", "n_folded")}
    folded = heads.join(past, F.col("symbol_id") == F.col("_symbol"), "left").withColumns(added).select(*heads.columns)
    return folded.unionByName(placed.filter("at > _until").drop("_until"), allowMissingColumns=True)


def read_means(state: DataFrame, as_of: Column, *, rate: float = scoring.DECAY, reference: str = "2024-01-01") -> DataFrame:
    """``symbol_id, mean_score, newest, n_material, last_score, last_summary`` as of a time not before the newest article."""
    ago = F.exp(-rate * ((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.lit(reference).cast("timestamp"))) / 3.6e9))
    w = F.when(F.col("at").isNull(), ago).otherwise(scoring.decay_weight("at", as_of, rate=rate))
    value = lambda folded, open_: F.sum(F.when(F.col("at").isNull(), F.col(folded)).otherwise(F.col(open_)) * w)
    last = F.struct("last_at", "last_id")
    return state.groupBy("symbol_id").agg(
        F.try_divide(value("weighted", "total"), value("weight", "n")).alias("mean_score"), F.max("newest").alias("newest"), F.sum(F.coalesce("n_folded", "n")).alias("n_material"),
        F.max_by("last_score", last).alias("last_score"), F.max_by("last_summary", last).alias("last_summary"),
    )


def best_of_buckets(rows: DataFrame, *, ts: str = "published_at", minutes: int = 5) -> DataFrame:
    """``symbol_id, source_name, bucket, id, score``: of each bucket the highest score, then the lowest id."""
    width = minutes * 60
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(ts)) / width) * width)
    named = rows.filter(F.col(ts).isNotNull()).select("symbol_id", "source_name", start.alias("bucket"), "id", "score")
    return _best(named)


def _best(rows: DataFrame) -> DataFrame:
    order = F.struct(F.coalesce("score", F.lit(-99.0)), -F.col("id"))
    return rows.groupBy("symbol_id", "source_name", "bucket").agg(F.max_by("id", order).alias("id"), F.max_by("score", order).alias("score"))


def revise_buckets(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """For a ``KeyedStore``: the best of each bucket after a batch, whenever its articles come."""
    return fresh if stored is None else _best(stored.unionByName(fresh))


def hourly_counts(rows: DataFrame, *, ts: str = "scored_at") -> DataFrame:
    return rows.filter(F.col(ts).isNotNull()).groupBy("kind", F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"))


def add_counts(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """For a ``KeyedStore``: events by kind and hour after a batch."""
    return fresh if stored is None else stored.unionByName(fresh).groupBy("kind", "hour").agg(F.sum("n").alias("n"))


def sliding_counts(hours: DataFrame, width: int = 24) -> DataFrame:
    """``kind, opened, n``: windows of ``width`` hours, one every hour, from counts by the hour."""
    opened = F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.col("hour") - F.make_dt_interval(F.lit(0), k)))
    return hours.select("kind", opened.alias("opened"), "n").groupBy("kind", "opened").agg(F.sum("n").alias("n"))


def append_batches(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends rows of keys not stored yet.

    The store is divided by a hash of the key, and a batch reads those parts
    alone that its keys fall into. A batch that runs twice appends nothing new.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        touched = [r[0] for r in fresh.select("key_bucket").distinct().collect()]
        try:
            stored = spark.read.parquet(path).filter(F.col("key_bucket").isin(touched)).select(key)
        except Exception as e:  # nothing is stored before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            fresh = fresh.join(stored, key, "left_anti")
        fresh.write.mode("append").partitionBy("key_bucket").parquet(path)

    return write


def raised(keys: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """For a ``KeyedStore`` of multipliers: those after a batch of signals, never lowered; without a target none."""
    return lambda stored, batch: upsert.raise_multiplier(stored if stored is not None else batch.limit(0).drop("seq"), batch, keys)


# ---------------------------------------------------------------- runs over what is there


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a table in the shared folder."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_batches(df: DataFrame, name: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over what is there, batch by batch."""
    path = shared_path(df.sparkSession, name)
    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()


def run_live_articles(stream: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """The store after all arrivals: active symbols' articles, one for each key."""
    path = shared_path(stream.sparkSession, "live-articles")
    run_batches(live_articles(stream, symbols), "live-articles", append_batches(path, key))
    return stream.sparkSession.read.parquet(path).drop("key_bucket")


def run_running_state(stream: DataFrame) -> KeyedStore:
    """The stored state after all arrivals of ``id, symbol_id, published_at, score, summary``, for ``read_means``."""
    spark = stream.sparkSession
    store = KeyedStore(spark, shared_path(spark, "running-state"), ("symbol_id",))
    run_batches(scored_rows(stream), "running-state", store.batches(keep_state))
    return store


def incremental_scores(store: KeyedStore, scores: KeyedStore, as_of: Column) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for ``scored_rows``: the state after a batch, and the means of the symbols it touches.

    The means come from the stored sums; no article is read again. A score is as
    of the batch that touched its symbol.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            parts = store.merge(held, number, keep_state)
            state = store.read(parts) if parts else None
            if state is not None:
                touched = state.join(held.select("symbol_id").distinct(), "symbol_id", "left_semi")
                means = read_means(touched, as_of).persist()
                try:
                    scores.merge(means, number, lambda old, new: new if old is None else upsert.upsert(old, new, ["symbol_id"], [F.lit(1)]))
                finally:
                    means.unpersist()
        finally:
            held.unpersist()

    return write


def run_incremental_scores(stream: DataFrame, as_of: Column) -> DataFrame:
    """Scores after all arrivals of ``id, symbol_id, published_at, score, summary``, each batch touching its symbols alone."""
    spark = stream.sparkSession
    store, scores = (KeyedStore(spark, shared_path(spark, name), ("symbol_id",)) for name in ("score-state", "scores"))
    run_batches(scored_rows(stream), "incremental-scores", incremental_scores(store, scores, as_of))
    return scores.read()


def run_monotone_multipliers(signals: DataFrame, target: DataFrame, keys: tuple[str, ...] = ("sector_name", "industry_name")) -> DataFrame:
    """The target after all signals; a batch rewrites the parts of the target that it touches."""
    spark = signals.sparkSession
    store = KeyedStore(spark, shared_path(spark, "multipliers"), tuple(keys))
    store.merge(target, -1, lambda _, rows: rows)
    run_batches(signals, "multipliers", store.batches(raised(list(keys))))
    return store.read()


def run_stored(stream: DataFrame, name: str, keys: tuple[str, ...], prepare: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """A table by ``keys`` after all arrivals: each batch prepared, and merged by ``combine``."""
    store = KeyedStore(stream.sparkSession, shared_path(stream.sparkSession, name), keys)
    write = store.batches(combine)
    run_batches(stream, name, lambda batch, number: write(prepare(batch), number))
    return store.read()


def run_bucket_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bucket_dedup`` over the events as a stream, all windows closed.

    A last, later event closes the open windows; the result leaves it out.
    """
    from ..plans import testviews

    articles = testviews.articles(spark, sf_dir).select("id", (F.col("symbol_id") % 10).alias("symbol_id"), "published_at", "score", "source_name")
    marker = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("symbol_id"), F.lit("2100-01-01").cast("timestamp").alias("published_at"), F.lit(None).cast("double").alias("score"), F.lit("").alias("source_name"))
    stream = landed_stream(articles.unionByName(marker), "bucket-events", 1_000)
    return run_available(bucket_dedup(stream), "bucket-dedup").filter("id >= 0")

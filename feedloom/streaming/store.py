"""Keyed tables that batches change part by part.

A table is divided by a hash of its keys. A batch reads the parts that its keys
fall into, and writes these anew under its number; then a row for each of them in
the table of commits makes them valid. What no commit names does not exist: a run
that ends between the two leaves the table as it was, and a batch that runs again
overwrites its leavings, or changes nothing if it was committed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyedStore:
    """A table at ``path`` in a folder that all executors share; ``parts`` grows with the table."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    parts: int = 64

    def commits(self) -> dict[int, int]:
        """The batch whose files hold each part now: as many rows as there are parts."""
        return {r["part"]: r["batch"] for r in self._log().groupBy("part").agg(F.max("batch").alias("batch")).collect()}

    def _log(self) -> DataFrame:
        schema = "batch long, part int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its parts; None before the first commit."""
        held = {p: b for p, b in self.commits().items() if only is None or p in only}
        if not held:
            return None
        folders = [f"{self.path}/data/batch={b}/part={p}" for p, b in sorted(held.items())]
        return self.spark.read.parquet(*folders)

    def merge(self, batch: DataFrame, number: int, combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> list[int]:
        """Change the table by a batch; the parts that it touched.

        ``combine`` takes the stored rows of these parts (None if there are none)
        and the batch, and gives all their rows after it. A committed number is
        left alone.
        """
        done = [r["part"] for r in self._log().filter(F.col("batch") == number).collect()]
        if done:
            return done
        # Spark's own hash of the keys: rows that meet by key in as many tasks as there are parts are of one part in each.
        part = F.pmod(F.hash(*self.keys), F.lit(self.parts)).cast("int")
        touched = sorted(r[0] for r in batch.select(part.alias("part")).distinct().collect())
        if not touched:
            return []
        near = lambda rows: rows.repartition(self.parts, *self.keys)
        held = self.read(touched)
        # Both sides move once, for the join or the groups of ``combine`` by key and for the files of parts alike.
        after = combine(None if held is None else near(held), near(batch)).withColumn("part", part)
        after.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/batch={number}")
        written = [(number, p) for p in touched]
        self.spark.createDataFrame(written, "batch long, part int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return touched

    def batches(self, combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that merges each batch under its number."""

        def write(batch: DataFrame, number: int) -> None:
            held = batch.persist()
            try:
                self.merge(held, number, combine)
            finally:
                held.unpersist()

        return write

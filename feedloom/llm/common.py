"""Helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Spark (Java) character class; ``bytes.split()`` in
#: Python splits at exactly these characters.
WHITE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (tests) that names none gets a folder made;
    on a cluster, where no other executor could read it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation, and what is
    read several times is computed once.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """Rows of ``df`` with the lowest hashes of ``keys``, at most ``most``.

    Rows must be distinct in ``keys``. The cut falls between two cells of the
    hash range, so equal tables give equal samples; a table within ``most`` comes
    whole. The driver sees 128 cell counts, and no task gathers the rows.
    """
    n = df.count()
    if n <= most:
        return df
    place = (F.xxhash64(*keys).cast("double") / 2.0**64 + 0.5) * (64.0 * n / most)
    held, last = 0, 0
    for row in sorted(df.filter(place < 128).groupBy(F.floor(place).alias("cell")).count().collect()):
        held += row["count"]
        if held > most:
            break
        last = row["cell"] + 1
    return df.filter(place < last)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of ``counts`` (column ``c``) with the highest counts, at most ``most``.

    The cut falls between two cells of a histogram of log counts, so rows of
    equal count stay together, and only the histogram reaches the driver.
    """
    cell = F.floor(F.log2("c") * 64)
    least, held = None, 0
    for row in sorted(counts.groupBy(cell.alias("cell")).count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        least = row["cell"]
    return counts.filter(cell >= least if least is not None else F.lit(False))


def binned(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``; null counts as below all."""
    out = F.when(F.lit(False), 0)
    for k in range(len(cuts), 0, -1):
        out = out.when(value >= cuts[k - 1], k)
    return out.otherwise(0)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null text as empty; other columns go."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes in each.

    A longer single value still comes whole, as a batch of one row.
    """
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)

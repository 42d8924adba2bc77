"""What the training-data operators share: reading tables, cutting lineage, Arrow map helpers."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch where the session has left the default: texts are long, and each worker holds a batch whole.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's rows of an Arrow batch to ``BATCH_ROWS`` if it still has Spark's default; a value that the user chose stays. Every operator here does this."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long) and the whole ``text`` of each row, null read as empty.

    Only these two columns are read, so other columns may have any name. One row out for each row in.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset (tests), an own one.

    What is put there (checkpoints, and folders named ``stored-``, ``sets-``, ``lm-`` and ``pipeline-`` with a random name) is
    read for as long as a result is used, so nothing here removes it, but for blocks that ``lm.train`` has merged into its arrays: whoever
    runs the job clears the folder after it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: later readers survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """As ``cut``, as a compressed table: for rows that hold texts."""
    path = path or f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries inside drop their shuffle files as they end: for such as are run once, whose results are written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in the life of a Python worker: for objects that take long to load. A worker runs one task at a time."""
    held = sys.__dict__.setdefault("_tidebar_kept", {})
    if key not in held:
        held[key] = make()
    return held[key]


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, rows: int = 256) -> DataFrame:
    """``mapInArrow`` with a function that ``make`` builds once in each task and that gets at most ``rows`` rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = f(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_column(value: Column, make: Callable[[], Callable[[list[str]], list]], kind: str, dtype: pa.DataType, rows: int = 256) -> Column:
    """A column computed from a text column (null read as empty) by a function that gets at most ``rows`` texts at once and is built once in each task."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for batch in batches:
            parts = [pa.array(f(batch.slice(at, rows).to_pylist()), dtype) for at in range(0, len(batch), rows)]
            yield pa.concat_arrays(parts) if parts else pa.array([], dtype)

    return run(F.coalesce(value.cast("string"), F.lit("")))


#: Least and most bits of a bitmap: 32 MB.
BITMAP_BITS = 1 << 20, 1 << 28


def bitmap(keys: DataFrame) -> np.ndarray:
    """16 bits (``BITMAP_BITS`` at least and most) for each key (one long column ``h``), with one set for each; or-ed in Spark into words of 64 bits."""
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], 1 << (16 * keys.count()).bit_length()))
    words = keys.select(F.pmod("h", F.lit(bits)).alias("at")).select(F.expr("shiftright(at, 6)").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(spark: SparkSession, bits: np.ndarray, key: Column) -> Column:
    """Whether a key may be among those of the bitmap: true for all that are, and for a few that aren't."""
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            at = np.mod(batch.to_numpy(zero_copy_only=False), np.int64(64 * len(own)))
            yield pa.array((own[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return run(key)


def crc_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n

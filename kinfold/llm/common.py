"""Shared plumbing of the training-data operators.

Intermediate tables are written to the shared folder the session names in
``spark.checkpoint.dir``, so that a lost executor costs a reread and not a rerun. They are
deleted as soon as nothing reads them any more (``discard``).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
ROW = ["kinfold_file", "kinfold_row"]


#: Where the tables of ``materialize`` are, for ``discard``.
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Where none is configured a local folder serves a session in one process (``local[...]``);
    on a cluster that is an error, because other executors could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the reread table.

    ``files`` is for tables of a few rows, which would else be a file for each shuffle partition.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no plan still to be run reads."""
    for df in tables:
        path = _STORED.pop(df, None)
        if path is not None:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to Python small enough for very long texts.

    One setting for all operators: the limit in bytes also holds for wide rows, so none
    lowers the number of rows for itself and leaves it so for the next.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Only id (long), text and what is to be kept, whatever other columns there are; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *keep,
    )


def with_rows(df: DataFrame) -> DataFrame:
    """``df`` with two more columns, ``ROW``, which tell a row of the files it reads from all others, whatever the rows hold.

    A table that is not read from files is written to the shared folder first.
    """
    place = [F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1])]
    try:
        return df.select("*", *place)
    except AnalysisException:
        return materialize(df, "rows").select("*", *place)


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """True for the rows whose labels are never learned; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(True))


def running_offsets(counts: DataFrame, keys: list[str], order: str, n: str, span: int = 4096) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over smaller ``order`` within ``keys``.

    Sums run in two levels, over spans of ``span`` buckets and within each span, so
    that no window holds more than ``span`` rows or the number of spans.
    """
    from pyspark.sql import Window as W

    spans = counts.withColumn("_span", F.expr(f"{order} div {span}"))
    top = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    low = W.partitionBy(*keys, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    heads = spans.groupBy(*keys, "_span").agg(F.sum(n).alias("_all"))
    heads = heads.select(*keys, "_span", F.coalesce(F.sum("_all").over(top), F.lit(0)).alias("_base"))
    inner = spans.withColumn("_in", F.coalesce(F.sum(n).over(low), F.lit(0)))
    joined = inner.join(heads, [*keys, "_span"])
    return joined.select(*keys, order, (F.col("_base") + F.col("_in")).alias("before"))


def in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (64 bits) may be among those that ``hash_map`` made ``bits`` of."""
    size = (8 * len(bits)).bit_length() - 1
    at = (hashes.view(np.uint64) >> np.uint64(64 - size)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def hash_map(hashes: DataFrame, bits: int, rows: int | None = None) -> np.ndarray:
    """For each of ``2**bits`` ranges a bit: whether the one column of ``hashes`` (long) has a value there.

    Joined in steps, so that neither a task nor the driver gets a map from each task. With
    ``rows``, how many hashes there are, a few are not read by many tasks, each with a map.
    """
    schema = "salt int, bits binary"
    if rows is not None:
        hashes = hashes.coalesce(max(1, min(256, rows // 500_000)))

    def mark(batches):
        found = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found[(values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([np.packbits(found).tobytes()], pa.binary())], ["salt", "bits"])

    def join(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for b in table.column("bits"):
            total |= np.frombuffer(b.as_buffer(), dtype=np.uint8)
        return pa.table({"salt": pa.array([table.column("salt")[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    parts = hashes.mapInArrow(mark, schema).groupBy("salt").applyInArrow(join, schema)
    parts = parts.withColumn("salt", F.col("salt") % 8).groupBy("salt").applyInArrow(join, schema)
    total = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in parts.collect():
        total |= np.frombuffer(r.bits, dtype=np.uint8)
    return total


def tidy() -> None:
    """Give memory that a finished task no longer needs back to the system: workers live on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished phases: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

"""Tables in the shared folder, and batches of bounded size for Python workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once.
SLICE_BYTES = 2 << 20
#: Rows up to which a table of ids and numbers counts as small enough to broadcast.
BROADCAST_ROWS = 100_000
#: Rows of an Arrow batch between Spark and a Python worker: texts of some kilobytes make batches of a few megabytes.
BATCH_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: spark.checkpoint.dir, or one set here in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there: its lineage ends at replicated files."""
    path = new_path(df.sparkSession, name)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS: a batch is held several times over, on both sides."""
    if int(spark.conf.get(_ARROW_ROWS)) > BATCH_ROWS:
        spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))


def handing_back(run: Callable) -> Callable:
    """A function for mapInArrow that, when a task ends, gives the worker's free memory back to the system; workers live on."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of GNU's library alone
        if trim is not None:
            trim(0)

    return wrapped


def bounded(df: DataFrame) -> DataFrame:
    """A stored table of ids and numbers, marked for broadcast if it has up to BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def redealt(df: DataFrame, key: str) -> DataFrame:
    """df, an aggregate by a long key, with the key computed anew.

    A join right above an aggregate takes over its partitions, and then Spark cannot
    split the partition of a hot key on the other side. With an exchange of its own
    on either side it can.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small table may come in one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that stored() has written; results that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quillon")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; -1 for a null id. Rows with 2 are held out from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(-1))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece has up to `rows` rows and `limit` bytes in the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def pieces(data: bytes, size: int = 8 << 20) -> Iterator[list[bytes]]:
    """The words between ASCII white space, in lists made from up to about `size` bytes each."""
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end

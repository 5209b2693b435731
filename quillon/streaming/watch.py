"""Watching source trees: new and changed files arrive as a stream, and each batch refreshes the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.tree import Index

BINARY = "path string, modificationTime timestamp, length long, content binary"


def changes(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, changed, length): files of the tree that are new. Contents are not read."""
    stream = spark.readStream.schema(BINARY).format("binaryFile").option("recursiveFileLookup", True).option("ignoreChangedFiles", True).load(root)
    return stream.select("path", F.col("modificationTime").alias("changed"), "length")


def watch(spark: SparkSession, index: Index, roots: dict[str, str], checkpoint: str, debounce: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Refreshes the index when files of any root arrive; the trigger's interval gathers bursts of changes.

    A refresh lists the trees anew, so that deleted files leave the index too.
    """

    def refresh(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.refresh(roots)

    streams = [changes(spark, root) for root in roots]
    arrived = streams[0]
    for other in streams[1:]:
        arrived = arrived.union(other)
    writer = arrived.writeStream.option("checkpointLocation", checkpoint).foreachBatch(refresh)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def bursts(events: DataFrame, gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """(root, started, ended, files) of change events (root, path, ts): events with smaller gaps are one burst.

    Session windows over event time: works on a stream, with a watermark for late events, and on a table.
    """
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("files"))
    return grouped.select("root", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "files")

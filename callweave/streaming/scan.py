"""Recordings that keep arriving: streams whose batches go through the scan, safe against replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callweave.sources.recordings import EXTENSIONS, FILE_SCHEMA, list_recordings, wanted

LISTING = "path string, length long, modificationTime timestamp"


def stream_recordings(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS, exclude_dirs: list[str] = ()) -> DataFrame:
    """(path, length, modificationTime) of files as they appear. A file is seen once under its name."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(root)
    below = F.substring_index(F.regexp_replace("path", "^[a-z]+:/+", "/"), root.rstrip("/"), -1)
    return files.select("path", "length", "modificationTime").where(wanted(below, extensions, list(exclude_dirs)))


def stream_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings (path, length, modificationTime) that are written to a folder as parquet, as they come."""
    return spark.readStream.schema(LISTING).option("recursiveFileLookup", "true").parquet(folder)


def _started(rows: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None) -> StreamingQuery:
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_scan(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None = None, **kw) -> StreamingQuery:
    """Runs handle(listing, batch) on what is new: at once until all is read, or at an interval such as 300 seconds.

    A ``FileLedger`` as the handle makes replayed batches harmless. Spark's file source shows a name
    once; ``watch_folder`` sees files that are recorded again as well.
    """
    return _started(stream_recordings(spark, root, **kw), checkpoint, handle, every)


def scan_listings(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Runs handle(listing, batch) on listings that are written to a folder, each batch once."""
    return _started(stream_listings(spark, folder), checkpoint, handle, every)


def watch_folder(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str = "300 seconds", **kw) -> StreamingQuery:
    """Lists the whole folder anew at an interval and runs handle(listing, batch): changed files come again.

    The trigger is a stream of ticks; a batch's rows are the listing, which Spark makes in parallel.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda _, batch: handle(list_recordings(spark, root, **kw), batch)).trigger(processingTime=every).start()

"""Structured Streaming forms of the watcher and the ingest loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.operators import clusters, ingest
from heliograph.plans.params import DEFAULT, Params


def file_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New photos of a folder as they appear, metadata only."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return ingest.scannable(files.select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size")))


def relevant(events: DataFrame) -> DataFrame:
    """Events (root, path, ts) that touch photos."""
    return events.filter(S.is_supported(F.col("path")) & ~S.is_hidden_path(F.col("path")))


def burst_windows(events: DataFrame, key: str, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """One row a quiet-separated burst of events; state goes once the watermark has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return window.select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("quiet_ts"), "n")


def flush_windows(events: DataFrame, width: str, late: str = "1 minute") -> DataFrame:
    """Counters flushed once a window, as progress displays are."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ingest.tumbling(timed, width)


def deduplicated(events: DataFrame, key: str, late: str = "1 minute") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upserts(read: Callable[[], DataFrame], last: Callable[[], int | None], write: Callable[[DataFrame, int], None], generation: Callable[[int], int]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that brings each batch of files into the catalogue, once a batch id.

    ``write`` keeps the batch id with the table that it replaces, and ``last`` tells it; a batch that
    is run again after it was written changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        done = last()
        if done is not None and batch_id <= done:
            return
        known = read()
        first = (known.agg(F.max("id")).first()[0] or 0) + 1
        write(ingest.upsert(known, batch, generation(batch_id), first), batch_id)

    return run


def identities(read: Callable[[], DataFrame], versions: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], params: Params = DEFAULT) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that gives new faces their clusters, dropping results of superseded files.

    Faces carry ``cache_key``, the version of their photo's file. ``versions`` gives the current
    one of every photo (photo_id, cache_key); a late result for an older file is left out.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        current = batch.join(versions().select("photo_id", "cache_key"), ["photo_id", "cache_key"], "left_semi")
        write(clusters.assign_batch(read(), current, params), batch_id)

    return run


def coordinator(step: Callable[[DataFrame, int], None], queued: Callable[[], DataFrame], loose: Callable[[], DataFrame], consolidate: Callable[[], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that works off a batch and, once the queue has drained, clusters all faces anew.

    ``loose`` gives the faces that were assigned since the last clustering, from their table, so a
    restart in between forgets nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.take(1):
            step(batch, batch_id)
        if not queued().take(1) and loose().take(1):
            consolidate()

    return run


def coalesced(requests: DataFrame) -> DataFrame:
    """Of all rescans that were asked for during a pass, the one that follows it."""
    return requests.agg(F.max("epoch").alias("epoch"), F.count(F.lit(1)).alias("asked")).filter("asked > 0")

"""Scans, change classification, pruning, bursts, queues."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.plans.params import CLOUD, DOWNLOADING, PENDING, READY
from heliograph.scratch import ship, written


ENTRY = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("mtime", pa.int64()), ("size", pa.int64())])
#: Bytes of a file that are read at once.
CHUNK = 1 << 20


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in folders; those that can't be listed and links give nothing."""
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            try:
                files, inner = fs.FileSystem.from_uri(path)
                infos = files.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            except (OSError, pa.ArrowException):
                continue
            scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            local = files.type_name == "local"
            found += [(scheme + i.path, i.type == fs.FileType.Directory, i.mtime, i.size) for i in infos if i.type in (fs.FileType.Directory, fs.FileType.File) and not (local and os.path.islink(i.path))]
        times = [t and int(t.timestamp()) for _, _, t, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([p for p, *_ in found], [d for _, d, _, _ in found], times, [n for *_, n in found]), ENTRY)], schema=ENTRY)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of all files below a folder, a level of folders at a time.

    A folder or file that can't be read is skipped; contents are never read.
    """
    kind = "path string, folder boolean, mtime long, size long"
    level, out = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), None
    while True:
        found = written(level.repartition("path").mapInArrow(_entries, kind), "folder-entries")
        files = found.filter("NOT folder").select("path", "mtime", "size")
        out = files if out is None else out.unionByName(files)
        level = found.filter("folder").select("path")
        if not level.take(1):
            return out


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of the photos under a folder."""
    rows = walk(spark, root).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    return scannable(rows).withColumn("cache_key", S.version_key(F.col("path"), F.col("mtime"), F.col("size")))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, out = batch.column("path").to_pylist(), []
        for path in paths:
            try:
                files, inner = fs.FileSystem.from_uri(path)
                sha = hashlib.sha256()
                with files.open_input_stream(inner) as f:
                    while part := f.read(CHUNK):
                        sha.update(part)
                out.append(sha.hexdigest())
            except (OSError, pa.ArrowException):
                out.append("")
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.string())], names=["path", "content_hash"])


def digests(files: DataFrame) -> DataFrame:
    """(path, content_hash) of files (path), read in parts whatever their size; '' of those that can't be read."""
    ship(files.sparkSession)
    return files.select("path").repartition("path").mapInArrow(_digests, "path string, content_hash string")


def hashes(spark: SparkSession, root: str) -> DataFrame:
    """Content digests of the files under a folder that aren't hidden."""
    return digests(walk(spark, root).filter(~S.is_hidden_path(F.col("path")))).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))


def scannable(files: DataFrame) -> DataFrame:
    return files.filter(S.is_supported(F.col("path")) & ~S.is_hidden_path(F.col("path")))


def classify(known: DataFrame, found: DataFrame) -> DataFrame:
    """Every path's change: new, changed, again (the same, but never finished), unchanged, gone."""
    old = known.select("path", F.col("id"), F.col("mtime").alias("_m"), F.col("size").alias("_s"), "thumb_status")
    joined = found.select("path", "mtime", "size").join(old, "path", "full")
    same = (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s"))
    change = F.when(F.col("_m").isNull(), "new").when(F.col("mtime").isNull(), "gone").when(same & (F.col("thumb_status") == READY), "unchanged").when(same, "again").otherwise("changed")
    return joined.select("path", "id", "mtime", "size", change.alias("change"))


def upsert(known: DataFrame, found: DataFrame, generation: int, first_id: int) -> DataFrame:
    """The catalogue after a scan: dates and places once found stay, changed files start again.

    New rows are numbered by path from ``first_id`` on; ``found`` may carry ``is_cloud``.
    """
    cloud = F.col("is_cloud") if "is_cloud" in found.columns else F.lit(False)
    fresh = found.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.when(cloud, CLOUD).otherwise(PENDING).alias("_status"))
    joined = known.join(fresh, "path", "left")
    seen, changed = F.col("_m").isNotNull(), F.col("_m").isNotNull() & ((F.col("mtime") != F.col("_m")) | (F.col("size") != F.col("_s")))
    restart = changed | (seen & (F.col("thumb_status") != READY))
    old = joined.withColumns({
        "seen": F.when(seen, F.lit(generation)).otherwise(F.col("seen")),
        "thumb_status": F.when(restart, F.col("_status")).otherwise(F.col("thumb_status")),
        "faces_scanned": F.when(changed, 0).otherwise(F.col("faces_scanned")),
        "content_hash": F.when(~F.coalesce(changed, F.lit(False)), F.col("content_hash")),
        "mtime": F.coalesce("_m", "mtime"),
        "size": F.coalesce("_s", "size"),
    }).select(*known.columns)
    from heliograph.operators.clusters import numbered

    new = fresh.join(known, "path", "left_anti")
    ids = numbered(new.select("path"), "path", "n")
    added = new.join(ids, "path").select("path", (F.col("n") + first_id - 1).alias("id"), F.col("_m").alias("mtime"), F.col("_s").alias("size"), F.col("_status").alias("thumb_status"), F.lit(generation).alias("seen"), F.lit(0).alias("faces_scanned"), F.lit(0).alias("favorite"), F.lit(0).alias("hidden"))
    return old.unionByName(added.select(*[c for c in added.columns if c in known.columns]), allowMissingColumns=True)


def unseen(known: DataFrame, found: DataFrame, roots_seen: bool) -> DataFrame:
    """Rows whose file is gone; none unless every root could be read and none changed meanwhile."""
    gone = known.join(found.select("path"), "path", "left_anti")
    return gone if roots_seen else gone.limit(0)


def add_roots(roots: DataFrame, paths: list[str]) -> DataFrame:
    return roots.select("path").union(roots.sparkSession.createDataFrame([(p,) for p in paths], "path string")).distinct()


def removed_with_root(photos: DataFrame, roots: DataFrame, path: str) -> DataFrame:
    """Photos below a root, by whole path components, that no other root holds.

    A photo's parent folders are its keys, so roots are found by an equality join.
    """
    below = photos.filter((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    left = roots.filter(F.col("path") != path).select(F.col("path").alias("parent"))
    held = below.select("id", F.explode(parents).alias("parent")).join(left, "parent", "left_semi").select("id").distinct()
    return below.join(held, "id", "left_anti")


def next_generation(previous: int) -> int:
    return max(time.time_ns() // 1_000_000, previous + 1)


def root_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Roots to watch and to stop watching."""
    return new.subtract(old).withColumn("change", F.lit("watch")).union(old.subtract(new).withColumn("change", F.lit("stop")))


def bursts(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Runs of events that follow each other within ``gap`` (inclusive)."""
    seconds = F.expr(f"interval {gap}")
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    fresh = F.coalesce(F.col("ts") > F.lag("ts").over(order) + seconds, F.lit(True))
    runs = events.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(order))
    return runs.groupBy(key, "_run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy("event_type", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def queue_order(jobs: DataFrame, priority: DataFrame, limit: int) -> DataFrame:
    """Jobs in the order workers take them: on-screen ones first, then first come; each id once."""
    firsts = jobs.groupBy("id").agg(F.min("place").alias("place")).join(priority.withColumn("_top", F.lit(0)), "id", "left")
    top = firsts.orderBy(F.coalesce("_top", F.lit(1)), "place").limit(limit)
    return top.select("id", F.row_number().over(Window.orderBy(F.coalesce("_top", F.lit(1)), "place")).alias("turn"))


def pending(jobs: DataFrame, in_flight: DataFrame, cancelled: DataFrame) -> DataFrame:
    return jobs.dropDuplicates(["id"]).join(in_flight, "id", "left_anti").join(cancelled, "id", "left_anti")


def profile(samples: DataFrame) -> DataFrame:
    return samples.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean"), F.sum("ms").alias("total"))


EXIF_FIELDS = "path string, taken string, lat double, lon double, make string, model string, lens string, f_number double, exposure double, iso long, focal double, width long, height long"


def details(images: DataFrame) -> DataFrame:
    """What the info card shows of local files (path, thumb_status, content); files in the cloud aren't read."""
    from heliograph.sources.exif import read_batches

    local = images.filter(~F.col("thumb_status").isin(CLOUD, DOWNLOADING)).select("path", "content")
    col, valid = F.col, S.valid_point(F.col("lat"), F.col("lon"))
    labels = {"camera": S.camera_label(col("make"), col("model")), "f_number": S.f_number_label(col("f_number")), "exposure": S.exposure_label(col("exposure")), "iso": S.iso_label(col("iso")), "focal": S.focal_label(col("focal"))}
    found = local.mapInPandas(read_batches, EXIF_FIELDS)
    return found.select("path", "lens", *[v.alias(k) for k, v in labels.items()], "width", "height", F.when(valid, col("lat")).alias("lat"), F.when(valid, col("lon")).alias("lon"))


def positions(images: DataFrame) -> DataFrame:
    """(path, taken_ts, lat, lon) from the EXIF block of photos (path, content); nulls where there is none."""
    from heliograph.sources.exif import read_batches

    return images.select("path", "content").mapInPandas(read_batches, EXIF_FIELDS).select(
        "path", S.exif_datetime(F.col("taken")).alias("taken_ts"), F.when(S.valid_point(F.col("lat"), F.col("lon")), F.col("lat")).alias("lat"), F.when(S.valid_point(F.col("lat"), F.col("lon")), F.col("lon")).alias("lon"), S.camera_label(F.col("make"), F.col("model")).alias("camera")
    )

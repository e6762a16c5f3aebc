"""Substring dedup with a sparse, distributed suffix array.

Every byte string of ``length`` bytes that also starts earlier loses its bytes. Sorting all
suffixes would move each byte ``length`` times, so the array is built in three narrowing steps:

* Equal texts become a class, numbered by their first document, so a suffix is one number: its
  place in all classes laid end to end.
* Of the ``width`` grams that start in a window of ``length`` bytes the one of the least hash is
  its anchor. Equal windows have equal anchors at equal offsets, so windows fall into runs
  around anchors, and a run whose anchor's hash is nowhere else holds nothing that repeats.
* The runs that are left are pieces of text. Equal pieces become one, with its first place.

What remains is sorted as a suffix array: sampled splitters range-partition the pieces by the
bytes that their anchors begin with, each bucket sorts its windows by multikey quicksort, a word
of eight bytes at a time and only what is still tied, and of windows that tie to the end the
first stays. A gram at a bucket's border may go on in the next one: its windows are compared
across buckets by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.storage import drop, materialize, ship

LENGTH = 100
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Pieces in a bucket, about.
BUCKET = 40_000


def spread(length: int) -> int:
    """How many grams compete in a window: a power of two, so that a minimum takes doublings only."""
    return 1 << max(0, (2 * length // 3).bit_length() - 1)


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sha, n) of all rows, and (base, sha, first_id, bytes) of the distinct texts, both written.

    ``base`` is where a text begins when all are laid end to end by first doc_id, nulls last, with a gap of a byte.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select("doc_id", F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes")).groupBy("doc_id", "sha", "n_bytes").agg(F.count(F.lit(1)).alias("n")), "document-rows")
    firsts = rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("n_bytes").alias("n_bytes"))
    order = [F.asc_nulls_last("first_id"), "sha"]
    ranged = materialize(firsts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "text-order")
    width = F.col("n_bytes") + 1
    parts = ranged.groupBy("part").agg(F.sum(width).alias("bytes"))  # a row a task
    starts = parts.select("part", (F.sum("bytes").over(Window.orderBy("part")) - F.col("bytes")).alias("start"))
    within = F.sum(width).over(Window.partitionBy("part").orderBy(*order)) - width
    places = ranged.join(F.broadcast(starts), "part").select("sha", "first_id", (F.col("start") + within).alias("base"))
    texts = docs.select(F.sha2(text, 256).alias("sha"), text.alias("text")).groupBy("sha").agg(F.first("text").alias("text"))
    return rows, materialize(texts.join(places, "sha").select("base", "sha", "first_id", F.col("text").cast("binary").alias("bytes")), "distinct-texts")


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on, by doubling."""
    with np.errstate(over="ignore"):
        power, size, block = np.uint64(0x9E3779B97F4A7C15), 1, data.astype(np.uint64) + np.uint64(1)
        out, have, left = None, 0, gram
        while left:
            if left & 1:
                n = len(data) - have - size + 1
                out, have = (block.copy() if out is None else out[:n] * power + block[have : have + n]), have + size
            left >>= 1
            if left:
                n = len(block) - size
                block, power, size = block[:n] * power + block[size : size + n], power * power, size * 2
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def anchor_runs(data: np.ndarray, inside: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, windows, the anchor's offset in the first, its hash.

    ``inside`` tells the windows (by their start) that lie within a text; others are left out.
    """
    width = spread(length)
    hashes = gram_hashes(data, length - width + 1)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)  # the leftmost of equals
    size = 1
    while size < width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(inside[: len(anchor)])
    if not len(at):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    own = anchor[at]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    start = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    return start, count, own[new] - start, hashes[own[new]].view(np.int64)


def _pieces_of(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, inside, place of each byte) of some whole texts, or of a part of a very long one with what its windows reach into."""
    bases, column = batch.column("base").to_numpy(), batch.column("bytes")
    held, places, ends, size = [], [], [], 0

    def together():
        data = np.concatenate(held)
        inside = np.ones(len(data), dtype=bool)
        for end in np.cumsum([len(h) for h in held]):
            inside[max(0, end - length + 1) : end] = False
        return data, inside, np.concatenate(places)

    for base, value in zip(bases, column):
        data = np.frombuffer(value.as_buffer(), dtype=np.uint8)
        for at in range(0, max(1, len(data) - length + 1), CHUNK):
            part = data[at : at + CHUNK + length - 1]
            if len(part) < length:
                continue
            held.append(part)
            places.append(np.arange(base + at, base + at + len(part)))
            size += len(part)
            if size >= CHUNK:
                yield together()
                held, places, size = [], [], 0
    if held:
        yield together()


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """(hash, base, start, count, offset) of every run of windows of every text."""
    schema = pa.schema([("hash", pa.int64()), ("base", pa.int64()), ("start", pa.int32()), ("count", pa.int16()), ("shift", pa.int16())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = np.sort(batch.column("base").to_numpy())
            for data, inside, place in _pieces_of(batch, length):
                start, count, shift, hashes = anchor_runs(data, inside, length)
                where = place[start]
                base = bases[np.searchsorted(bases, where, side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip((hashes, base, where - base, count, shift), schema)], schema=schema)

    return texts.select("base", "bytes").mapInArrow(run, "hash long, base long, start int, count short, shift short")


def multikey(data: np.ndarray, places: np.ndarray, length: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(item, group): the items whose ``length`` bytes tie with another's of their group, sorted; ties share a group.

    A level compares one word of the items that still tie; the least, equal and greater ones of the
    classic algorithm are the runs that the level's sort leaves.
    """
    item = np.arange(len(places))
    group = np.zeros(len(places), dtype=np.int64) if group is None else group
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])] if length >= 8 else [None]:
        if not len(item):
            break
        if depth is None:  # shorter than a word
            word = np.zeros(len(item), dtype=np.uint64)
            for k in range(length):
                word = word << np.uint64(8) | data[places[item] + k].astype(np.uint64)
        else:
            word = windows[places[item] + depth].view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((word, group))
        item, group, word = item[order], group[order], word[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
        group = np.cumsum(new)
        tied = np.bincount(group)[group] > 1
        item, group = item[tied], group[tied]
    return item, group


def _runs(flag: np.ndarray, row: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first step, steps) of each run of flagged items that follow each other in a row."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (row[at][1:] != row[at][:-1]) | (step[at][1:] != step[at][:-1] + 1)])
    return row[at][new], step[at][new], np.diff(np.append(np.flatnonzero(new), len(at)))


def first_windows(pieces: DataFrame, length: int) -> DataFrame:
    """(base, at, count, window): runs of windows that no earlier one of the bucket equals.

    ``window`` is null, or holds the bytes of one whose gram may also be in a neighbouring bucket.
    """
    gram = length - spread(length) + 1
    schema = pa.schema([("base", pa.int64()), ("at", pa.int64()), ("count", pa.int32()), ("window", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = [b for b in batches if b.num_rows]  # of a bounded number of pieces, each shorter than two windows
        if not bucket:
            return
        held = pa.Table.from_batches(bucket)
        piece = pa.concat_arrays(held.column("piece").chunks)
        offsets = np.frombuffer(piece.buffers()[1], dtype=np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64)
        data = np.concatenate([np.frombuffer(piece.buffers()[2], dtype=np.uint8)[: offsets[-1]], np.zeros(8, dtype=np.uint8)])
        base, at, shift = (held.column(n).to_numpy().astype(np.int64) for n in ("base", "at", "shift"))
        size = np.diff(offsets) - length + 1
        row, same = multikey(data, offsets[:-1] + shift, gram)
        family = np.zeros(len(base), dtype=np.int64)  # of pieces whose anchors begin alike; 0: there is one
        family[row] = same

        # Pieces of the least and the greatest gram; the buckets are ranges of grams.
        grams = [data[o : o + gram].tobytes() for o in offsets[:-1] + shift]
        border = np.isin(np.array(grams, dtype=object), [min(grams), max(grams)])

        alone = np.flatnonzero((family == 0) & ~border)
        yield batch_of(base[alone], at[alone], size[alone])
        many = np.flatnonzero((family > 0) | border)
        if not len(many):
            return
        owner = np.repeat(many, size[many])
        step = np.arange(len(owner)) - np.repeat(np.cumsum(size[many]) - size[many], size[many])
        places, when = offsets[owner] + step, at[owner] + step
        # Equal windows have their anchors at equal offsets.
        item, tie = multikey(data, places, length, family[owner] * (4 * length) + shift[owner] - step)
        first = np.ones(len(owner), dtype=bool)
        order = np.lexsort((when[item], tie))
        first[item[order][1:][tie[order][1:] == tie[order][:-1]]] = False
        inner = ~border[owner]
        r, s, n = _runs(first & inner, owner, step)
        yield batch_of(base[r], at[r] + s, n)
        outer = np.flatnonzero(first & ~inner)
        for lo in range(0, len(outer), 10_000):
            some = outer[lo : lo + 10_000]
            bytes_ = np.lib.stride_tricks.sliding_window_view(data, length)[places[some]]
            yield batch_of(base[owner[some]], when[some], np.ones(len(some)), [w.tobytes() for w in bytes_])

    def batch_of(base, at, count, window=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(base), pa.array(at), pa.array(count).cast(pa.int32()), pa.array(window or [None] * len(base), pa.binary())], schema=schema)

    return pieces.select("base", "at", "shift", "piece").mapInArrow(run, "base long, at long, count int, window binary")


def removals(texts: DataFrame, length: int) -> DataFrame:
    """(base, n_removed, n_spans, kept_sha256) of the texts (base, bytes) that may lose bytes."""
    schema = pa.schema([("base", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in schema]
            runs = {n: batch.column(n) for n in ("starts", "counts", "kept", "kept_counts")}
            for row, base in enumerate(batch.column("base").to_pylist()):
                data = np.frombuffer(batch.column("bytes")[row].as_buffer(), dtype=np.uint8)
                starts, counts, kept, kept_counts = (np.array(runs[n][row].as_py() or [], dtype=np.int64) for n in runs)
                change = np.zeros(len(data) + 1, dtype=np.int64)  # windows that may repeat, less those that come first
                for begin, many, sign in ((starts, counts, 1), (kept - base, kept_counts, -1)):
                    np.add.at(change, begin, sign)
                    np.add.at(change, begin + many, -sign)
                repeats = np.flatnonzero(np.cumsum(change)[:-1] > 0)
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                edge[repeats] += 1
                edge[repeats + length] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                spans = np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1)
                for column, value in zip(out, (base, int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return texts.select("base", "bytes", "starts", "counts", "kept", "kept_counts").mapInArrow(run, "base long, n_removed long, n_spans long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text).

    A null text is empty. Rows are in order of doc_id, rows without one last; of rows with one
    doc_id and different texts the one of the smaller SHA-256 comes first, and of repeated rows one
    does. A text of fewer than ``length`` bytes loses nothing. An empty table gives no rows;
    other columns are ignored. Runs of one byte or of a short period have an anchor a byte, and
    cost ``length`` bytes of shuffle for each until equal pieces are one.
    """
    spark = docs.sparkSession
    ship(spark)
    rows, texts = classes(docs)
    runs = materialize(anchors(texts, length), "anchor-runs")
    again = materialize(runs.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "repeated-anchors")
    maybe = runs.join(again, "hash").groupBy("base").agg(F.collect_list(F.struct("start", "count", "shift")).alias("runs"))  # of one text
    maybe = materialize(maybe, "repeated-runs")
    drop(runs)

    gram = length - spread(length) + 1
    cut = texts.select("base", "bytes").join(maybe, "base").select("base", "bytes", F.explode("runs").alias("r"))
    piece = F.substring(F.col("bytes"), F.col("r.start") + 1, F.col("r.count") + (length - 1))
    cut = cut.select("base", (F.col("base") + F.col("r.start")).alias("at"), F.col("r.shift").cast("int").alias("shift"), piece.alias("piece"))
    # A text's base grows with its place, so both minima are of the first equal piece.
    pieces = materialize(cut.groupBy("piece").agg(F.min("base").alias("base"), F.min("at").alias("at"), F.min("shift").alias("shift")), "pieces")
    buckets = max(spark.sparkContext.defaultParallelism, -(-pieces.count() // BUCKET))
    sorted_ = pieces.withColumn("gram", F.substring("piece", F.col("shift") + 1, F.lit(gram))).repartitionByRange(buckets, "gram", "piece")
    found = materialize(first_windows(sorted_, length), "first-windows")
    across = found.filter("window IS NOT NULL").groupBy("window").agg(F.min("base").alias("base"), F.min("at").alias("at"))
    kept = found.filter("window IS NULL").select("base", "at", "count").unionByName(across.select("base", "at", F.lit(1).alias("count")))
    kept = kept.groupBy("base").agg(F.collect_list(F.struct("at", "count")).alias("kept"))  # of one text

    told = texts.select("base", "bytes").join(maybe, "base").join(kept, "base", "left")
    told = told.select("base", "bytes", F.col("runs.start").alias("starts"), F.col("runs.count").alias("counts"), F.col("kept.at").alias("kept"), F.col("kept.count").alias("kept_counts"))
    cuts = removals(told, length)
    # Written, so that the join with a text of very many documents can be split.
    result = materialize(texts.select("base", "sha", "first_id").join(cuts, "base", "left").drop("base"), "text-cuts")
    one = rows.join(result, "sha")
    each = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1)
    whole = ~stays & (F.col("n_bytes") >= length)
    pick = lambda copy, name, default: F.when(whole, copy).when(stays, F.coalesce(name, default)).otherwise(default).alias(name)
    zero = F.lit(0).cast("long")
    return each.select("doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", zero), pick(F.lit(1).cast("long"), "n_spans", zero), pick(F.sha2(F.lit(""), 256), "kept_sha256", F.col("sha")))

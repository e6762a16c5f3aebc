"""Best-fit packing of token sequences by a plan over length counts.

Documents are tokenized once into pieces of at most ``capacity`` tokens. Only the histogram
of piece lengths (at most ``capacity`` rows whatever the corpus holds) reaches the driver,
where best-fit decreasing runs over counts: every step places a whole run of equally long
pieces into a run of equally full sequences. A piece then finds its slot through its rank
among the pieces of its length. Ranks are made without gathering a length anywhere: a piece
has a rank within its task's output, and per-task counts are summed up to a start for every
(task, length).
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.storage import materialize
from heliograph.llm.tokenizers import encoder

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text), ranked within its length and task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in (s for b in batches for s in slices(b)):
            ids, offsets = encode.encode_column(batch.column("text"))
            out = [[] for _ in schema]
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[offsets[row] : offsets[row + 1]], end_id).astype("<u4")
                for number, start in enumerate(range(0, len(own), capacity)):
                    cut = own[start : start + capacity]
                    rank = seen.get(len(cut), 0)
                    seen[len(cut)] = rank + 1
                    for column, value in zip(out, (doc_id, number, start, len(cut), zlib.crc32(cut.tobytes()), part, rank)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots as runs: (length, first rank, pieces per sequence, first sequence, offset in it).

    Rank r of a length, from its run's first rank on, goes to sequence
    first + (r - first rank) // per, at offset + ((r - first rank) % per) * length.
    ``counts`` has a row per length at most, so the work depends on ``capacity`` alone.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # tokens left -> runs of sequences [from, to)
    rooms: list[int] = []  # the keys of room, ascending
    sequences, plan = 0, []

    def put(left: int, lo: int, hi: int) -> None:
        if left and hi > lo:
            if left not in room:
                bisect.insort(rooms, left)
            room.setdefault(left, []).append((lo, hi))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):  # the tightest sequences that have room
                left = rooms[at]
                lo, hi = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:
                left, per = capacity, capacity // length
                lo, hi = sequences, sequences + -(-todo // per)
                sequences = hi
            per = left // length
            full, rest = divmod(min(todo, per * (hi - lo)), per)
            plan.append((length, rank, per, lo, capacity - left))
            put(left - per * length, lo, lo + full)
            if rest:
                put(left - rest * length, lo + full, lo + full + 1)
            put(left, lo + full + (rest > 0), hi)
            rank, todo = rank + full * per + rest, todo - full * per - rest
    return plan


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents (doc_id, text; other columns are ignored) into sequences.

    A null or empty text is the end id alone. Only documents longer than ``capacity`` are cut;
    all their pieces but the last fill a sequence each. Repeated rows are packed each. An empty
    table gives no rows. Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_part = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_part.select("part", "length", F.coalesce(before, F.lit(0)).cast("long").alias("first"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first"))

    runs = np.array(best_fit_plan(counts, capacity), dtype=np.int64).reshape(-1, 5)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    plan = docs.sparkSession.sparkContext.broadcast(runs[order])  # bounded by capacity, not by the corpus
    out_schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        wide = np.int64(1) << 40
        keys = slots[:, 0] * wide + slots[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = slots[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            step = rank - run[:, 1]
            placed = [pa.array(run[:, 3] + step // run[:, 2]), pa.array(run[:, 4] + step % run[:, 2] * length)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + placed, names=[*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, out_schema)

"""Product codes of vectors in exact integers.

Components become integers, so that sums and distances are exact and no result depends on how
rows are dealt. The codebooks are broadcast (entries x dimensions numbers, whatever the table
holds); Arrow batches find every part's nearest entry by norm expansion and integer matrix
products; a task's sums per entry are merged by a grouped shuffle each round. Vectors are read
again each round and never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.storage import materialize, ship
from heliograph.llm.words import small_side

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components that are held as 64-bit integers at once.
CELLS = 1 << 20
MERGED = "part int, entry int, place int, total long"


def usable(vector: Column, parts: int = PARTS) -> Column:
    """Vectors that can be cut into parts and whose components are all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0) & (F.size(vector) % parts == 0), F.lit(False))


def integers(flat: np.ndarray, dim: int, parts: int, scale: int) -> np.ndarray:
    """(parts, rows, components) of flattened vectors as integers, in Python's own where 64 bits might not do."""
    floors = np.floor(flat.astype(np.float64) * scale)
    small = not floors.size or np.abs(floors).max() < math.isqrt((1 << 60) // dim)
    whole = floors.astype(np.int64) if small else np.frompyfunc(int, 1, 1)(floors)
    return whole.reshape(-1, parts, dim // parts).transpose(1, 0, 2)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, rows): each part's first nearest entry, and its squared distance."""
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    apart = (book * book).sum(2)[:, None, :] - 2 * np.matmul(x, book.transpose(0, 2, 1))
    code = apart.argmin(2)
    return code, np.take_along_axis(apart, code[:, :, None], 2)[:, :, 0] + (x * x).sum(2)


def _arrays(batches: Iterable[pa.RecordBatch], dim: int, parts: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, CELLS // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            own = batch.slice(at, step)
            yield own, integers(own.column("embedding").flatten().to_numpy(zero_copy_only=False), dim, parts, scale)


def entry_sums(vectors: DataFrame, book: np.ndarray, scale: int) -> DataFrame:
    """(part, entry, place, total): component sums of each entry's parts; place -1 holds their number."""
    parts, entries, width = book.shape
    shared = vectors.sparkSession.sparkContext.broadcast(book)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for _, x in _arrays(batches, parts * width, parts, scale):
            code, _ = nearest(x, shared.value)
            member = (code[:, None, :] == np.arange(entries)[None, :, None]).astype(x.dtype)
            held[:, :, 0] += member.sum(2).astype(np.int64)
            held[:, :, 1:] += np.matmul(member, x).astype(np.int64)
        p, e, s = np.nonzero(np.repeat(held[:, :, :1] > 0, width + 1, axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((p, e, s - 1, held[p, e, s]), schema)], schema=schema)

    return vectors.select("embedding").mapInArrow(run, MERGED).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """(parts, entries, components) after ``rounds`` of assignment and floored means; None of an empty table.

    All vectors must be usable. The first entries are the vectors of the smallest ids, fewer if
    there are fewer vectors; entries that nothing is nearest to stay.
    """
    order = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding")
    seeds = [r[0] for r in order.limit(entries).collect()]
    if not seeds:
        return None
    dim = len(seeds[0])
    if any(len(s) != dim for s in seeds):
        seeds = [r[0] for r in order.filter(F.size("embedding") == dim).limit(entries).collect()]
    book = integers(np.array(seeds, dtype=np.float64).ravel(), dim, parts, scale)
    own = vectors.filter(F.size("embedding") == dim)
    for _ in range(rounds):
        sums = {(r["part"], r["entry"], r["place"]): r["total"] for r in entry_sums(own, book, scale).collect()}  # parts x entries x components at most
        book = book.copy()
        for (part, entry, place), total in sums.items():
            if place >= 0:
                book[part, entry, place] = total // sums[part, entry, -1]
    return book


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in book.ravel()).encode()).hexdigest()


def encode_vectors(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the usable rows of (vec_id, embedding, label).

    Rows go whose vector is null, empty, not a multiple of ``parts`` long, or holds null or
    non-finite components, and those of another length than the usable vector of the smallest
    vec_id. Repeated rows keep a row each; rows without a vec_id come last when entries are
    chosen. Null labels are a label. An empty table gives no rows; other columns are ignored.
    Distances are exact at any size, and a sum that 64 bits can't hold ends the job.
    """
    spark = rows.sparkSession
    ship(spark)
    kept = rows.select("vec_id", "embedding", "label").filter(usable(F.col("embedding"), parts))
    book = codebooks(kept, parts, entries, rounds, scale)
    if book is None:
        return kept.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(n) for n in ("error", "label_error")], F.lit(digest(np.empty(0))).alias("codebooks_sha256"))
    dim, shared = book.shape[0] * book.shape[2], spark.sparkContext.broadcast(book)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _arrays(batches, dim, parts, scale):
            code, far = nearest(x, shared.value)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([bytes(c).hex() for c in code.T.astype(np.uint8)]), pa.array(far.sum(0).tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = kept.filter(F.size("embedding") == dim).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    coded = materialize(coded, "vector-codes")
    # Written, so that the join with a label of very many vectors can be split.
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(small_side(sums), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))

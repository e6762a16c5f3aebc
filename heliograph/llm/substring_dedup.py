"""Substring deduplication: repeated paragraphs by MinHash banding, then repeated passages anywhere.

A paragraph is a line of at least MIN_WORDS words. With six bands of two MinHashes a pair of
Jaccard similarity 0.8 collides with probability 0.997, one of 0.9 with 0.9999 and equal ones
always. Colliding paragraphs are verified on whole shingle sets, and of each component of
verified links all paragraphs but the first are taken out. In the lines left, runs of SPAN_WORDS
or more words that occurred before are cut, wherever they begin and however they are wrapped.

Texts are split into words and hashed once for both: a pass gives every paragraph's set digest
and MinHash keys and every document's window keys. Texts are read again only where paragraphs
collide, where window keys repeat, and to be cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.packing import slices
from heliograph.llm.passages import GRAM, cut_rows, lines_of, place, repeated_windows, window_keys
from heliograph.llm.passages import WORDS as SPAN_WORDS
from heliograph.llm.similar import HELD_KEYS, components_of, digests, held_keys, minhash_keys, shingles_of, word_hashes
from heliograph.llm.storage import drop_all, fresh_names, materialize

SIZE = 5
NUM, DEN = 80, 100
BANDS, ROWS = 6, 2
MIN_WORDS = 20
ADDED = ("n_paragraphs", "n_removed", "first_doc_ids", "n_spans", "n_span_words", "n_repeat_words")
#: Rows of one pass over the texts: a paragraph (id, n, d0, d1, line), a key of one (key, id, other), a text's window keys.
HASHED = "_row long, id long, line int, n long, d0 long, d1 long, key long, other long, keys array<long>, key_lines array<int>"


def _number(batches: Iterable[pa.RecordBatch], row: str) -> Iterator[pa.RecordBatch]:
    """Rows with a number that leaves as many numbers free as the row has lines."""
    following = TaskContext.get().partitionId() << 40
    for batch in batches:
        lines = pc.fill_null(pc.count_substring(batch.column("text"), "\n"), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = following + np.cumsum(lines)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - lines)], names=[*batch.schema.names, row])
        following = int(ends[-1]) if len(ends) else following


def numbered(docs: DataFrame, row: str = "_row") -> DataFrame:
    """``docs`` written down with a column ``row``, which is not null and differs from row to row."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return materialize(docs.mapInArrow(partial(_number, row=row), ", ".join([*fields, f"`{row}` long"])), "numbered")


def _hashed(batches: Iterable[pa.RecordBatch], min_words: int, size: int, bands: int, rows: int, span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows of HASHED from (_row, text)."""
    kinds = {"_row": pa.int64(), "id": pa.int64(), "line": pa.int32(), "n": pa.int64(), "d0": pa.int64(), "d1": pa.int64(), "key": pa.int64(), "other": pa.int64(), "keys": pa.list_(pa.int64()), "key_lines": pa.list_(pa.int32())}
    schema = pa.schema(list(kinds.items()))

    def rows_of(count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(count, k) for c, k in kinds.items()], schema=schema)

    def flush() -> pa.RecordBatch:
        key, ids, other = held_keys(held)
        return rows_of(len(key), key=key, id=ids, other=other)

    held, seen = [], set()
    for batch in (s for b in batches for s in slices(b)):
        own = batch.column("_row").to_numpy(zero_copy_only=False)
        lines, ends = lines_of(batch.column("text"))
        words, bounds = word_hashes(lines)
        row_of_line = np.repeat(np.arange(len(own)), np.diff(ends))
        line_of = np.arange(len(lines)) - ends[:-1][row_of_line]

        counts = np.diff(bounds)
        long_lines = np.flatnonzero(counts >= min_words)
        inside = np.repeat(counts >= min_words, counts)
        values, cut = shingles_of(words[inside], np.concatenate([[0], np.cumsum(counts[long_lines])]), size)
        low, high = digests(values, cut)
        ids = own[row_of_line[long_lines]] + line_of[long_lines]
        yield rows_of(len(ids), _row=pa.array(own[row_of_line[long_lines]]), id=pa.array(ids), line=pa.array(line_of[long_lines], pa.int32()), n=pa.array(np.diff(cut), pa.int64()), d0=pa.array(low, pa.int64()), d1=pa.array(high, pa.int64()))
        fresh = np.flatnonzero(np.fromiter((d not in seen and not seen.add(d) for d in low), dtype=bool, count=len(low)))  # equal sets have equal keys
        keys, owners = minhash_keys(*_chosen(values, cut, fresh), bands=bands, rows=rows)
        held.append((keys, ids[fresh][owners]))
        if sum(len(k) for k, _ in held) > HELD_KEYS:
            yield flush()
            seen.clear()

        keys, places, owners = window_keys(words, bounds[ends], span, gram)
        at = np.searchsorted(bounds, places, side="right") - 1
        listed = pa.array(np.searchsorted(owners, np.arange(len(own) + 1)), pa.int32())
        full = np.flatnonzero(np.diff(listed.to_numpy()) > 0)
        of_text = pa.ListArray.from_arrays(listed, pa.array(keys.view(np.int64))).take(pa.array(full)), pa.ListArray.from_arrays(listed, pa.array(line_of[at], pa.int32())).take(pa.array(full))
        yield rows_of(len(full), _row=pa.array(own[full]), keys=of_text[0], key_lines=of_text[1])
    if held:
        yield flush()


def _chosen(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some rows."""
    sizes = np.diff(bounds)
    taken = np.zeros(len(sizes), dtype=bool)
    taken[rows] = True
    return values[np.repeat(taken, sizes)], np.concatenate([[0], np.cumsum(sizes[rows])])


def _texts(docs: DataFrame, paragraphs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the paragraphs wanted."""
    wanted = paragraphs.join(ids, "id", "left_semi").select("id", "_row", "line")
    return docs.select("_row", "text").join(wanted, "_row").select("id", F.get(F.split("text", "\n"), F.col("line")).alias("text"))


def dedup_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, size: int = SIZE, num: int = NUM, den: int = DEN, bands: int = BANDS, rows: int = ROWS, span: int = SPAN_WORDS) -> DataFrame:
    """``docs`` without repeated paragraphs and passages, and ADDED columns that tell what went.

    Of a component of similar paragraphs the first by (doc_id, line) stays; n_paragraphs and
    n_removed count lines. Of equal windows of ``span`` words (A-Z lowered, any white space
    between) that touch no line removed, the first by (doc_id, place) stays and the words of the
    others are cut: n_spans runs of n_span_words words. first_doc_ids lists the documents that hold
    what was removed. n_repeat_words counts a text's words in paragraphs or windows that
    another text or line has too, those that stay included. Runs shorter than ``span`` stay, so a
    passage with edits that is not a line is cut only where so many words in a row are unedited.
    A null text stays null. Rows without a doc_id are documents of their own, after all others
    and in order of reading, and are not listed. Repeated rows, and rows of one doc_id, keep a
    row each and are the same place, so they don't repeat each other; an empty table gives no
    rows. Columns with the added names are replaced; any other name may occur.
    """
    names = [c for c in docs.columns if c.lower() not in ADDED]
    number, = fresh_names(names, "_row")
    whole = numbered(docs.select(*names), number)
    own = whole.select(F.col(number).alias("_row"), "doc_id", "text")
    read = partial(_hashed, min_words=min_words, size=size, bands=bands, rows=rows, span=span, gram=min(GRAM, span))
    hashed = materialize(own.select("_row", "text").mapInArrow(read, HASHED), "hashed-paragraphs")
    paragraphs = hashed.filter("n IS NOT NULL").select("id", "_row", "line", "n", "d0", "d1")
    found = components_of(paragraphs.select("id", "n", "d0", "d1"), hashed.filter("key IS NOT NULL").select("key", "id", "other"), partial(_texts, own, paragraphs), size, num, den)
    found = materialize(found, "paragraph-components")

    named = paragraphs.join(found.select("id", "component"), "id").join(own.select("_row", "doc_id"), "_row")
    placed = materialize(named.select("_row", "line", "component", place(F.col("line")).alias("place")), "placed-paragraphs")
    drop_all(found)
    first = placed.groupBy("component").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").drop("texts")
    judged = placed.join(first, "component", "left")
    gone = F.col("place") != F.col("first")
    by_row = judged.groupBy("_row").agg(
        F.count(F.lit(1)).cast("int").alias("n_paragraphs"),
        F.collect_set(F.when(gone, F.col("line"))).alias("gone"),
        F.collect_set(F.when(F.col("first").isNotNull(), F.col("line"))).alias("repeated"),
        F.collect_set(F.when(gone, F.col("first.doc_id"))).alias("holders"),
    )
    by_row = materialize(by_row, "repeated-paragraphs")
    drop_all(placed)

    windows = repeated_windows(own, hashed.filter("keys IS NOT NULL").select("_row", "keys", "key_lines"), by_row.select("_row", "gone"), span)
    drop_all(hashed)
    marks = by_row.join(windows, "_row", "full")
    return cut_rows(whole, marks, names, number, span)

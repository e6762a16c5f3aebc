"""Passages repeated inside texts: equal windows of words wherever they lie, cut but for the first.

1. A text is its sequence of words, so lines and their wrapping play no part. Every window of WORDS
   words has as its key the least hash of the GRAM-word grams in it; equal windows have equal keys,
   and one gram is the least of a run of windows, so a text has few of them.
2. Only windows whose key occurs at two places are listed, told by key and window hash (128 bits).
3. Of equal windows the first by (doc_id, place) stays; the words of the others are cut. A window that
   overlaps its own first occurrence in a text stays, so a text that repeats itself keeps a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.packing import slices
from heliograph.llm.similar import U, mix, word_hashes
from heliograph.llm.storage import drop_all, fresh_names, materialize

WORDS = 50
GRAM = 16
#: Words as word_hashes splits them.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines of texts, one after another, and each text's bounds; a null text has an empty line."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.split_pattern(texts.take(pa.array(np.arange(len(texts)))), "\n")
    ends = np.asarray(split.offsets.to_numpy(), dtype=np.int64)
    return split.flatten(), ends - ends[0] if len(ends) else np.zeros(1, dtype=np.int64)


def _chained(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` neighbours, by doubling; the last step may overlap."""
    reach = 1
    while reach < length:
        step = min(reach, length - reach)
        words = mix(words[:-step] * U(0x9E3779B97F4A7C15) + words[step:]) if len(words) > step else words[:0]
        reach += step
    return words


def _least(x: np.ndarray, length: int) -> np.ndarray:
    """Where the leftmost least of every ``length`` neighbours of ``x`` is."""
    at, reach = np.arange(len(x)), 1
    while reach < length:
        step = min(reach, length - reach)
        a, b = (at[:-step], at[step:]) if len(at) > step else (at[:0], at[:0])
        at = np.where(x[b] < x[a], b, a)
        reach += step
    return at


def _runs(words: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes; the place of each window's least gram; which windows lie in one text) of texts' words one after another."""
    grams = mix(_chained(words, gram))
    least = _least(grams, size - gram + 1)
    inside = np.zeros(len(least), dtype=bool)
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= size:
            inside[a : b - size + 1] = True
    return grams, least, inside


def window_keys(words: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, texts) of the runs of windows with one least gram, in order."""
    grams, least, inside = _runs(words, ends, size, gram)
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    start[np.intersect1d(ends[:-1], np.flatnonzero(inside))] = True
    at = np.flatnonzero(start)
    return grams[least[at]], least[at], np.searchsorted(ends, at, side="right") - 1


def _listed(batches: Iterable[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(key, hash, _row, doc_id, at) for the windows of rows (_row, doc_id, text, keys, gone) whose key is among the row's and that touch no line gone."""
    for batch in (s for b in batches for s in slices(b)):
        lines, line_ends = lines_of(batch.column("text"))
        words, bounds = word_hashes(lines)
        ends = bounds[line_ends]
        grams, least, inside = _runs(words, ends, size, gram)
        if not len(least):
            continue
        lost = np.zeros(len(words) + 1, dtype=np.int64)
        for row, gone in enumerate(batch.column("gone").to_pylist()):
            for line in gone or []:
                lost[bounds[line_ends[row] + line] + 1 : bounds[line_ends[row] + line + 1] + 1] = 1
        lost = np.cumsum(lost)
        inside &= lost[size : len(least) + size] == lost[: len(least)]
        wanted, hashes, keys = batch.column("keys"), _chained(words, size), grams[least]
        for row in range(batch.num_rows):
            own = slice(ends[row], max(ends[row], ends[row + 1] - size + 1))
            inside[own] &= np.isin(keys[own], np.array(wanted[row].as_py(), dtype=np.int64).view(U))
        at = np.flatnonzero(inside)
        rows = np.searchsorted(ends, at, side="right") - 1
        taken = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[at].view(np.int64)), pa.array(hashes[at].view(np.int64)), batch.column("_row").take(taken), batch.column("doc_id").take(taken), pa.array(at - ends[rows])],
            names=["key", "hash", "_row", "doc_id", "at"],
        )


def spans(starts: list[int], size: int) -> list[tuple[int, int]]:
    """Ranges of words that windows of ``size`` words from ``starts`` cover."""
    out: list[tuple[int, int]] = []
    for a in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], a + size)
        else:
            out.append((a, a + size))
    return out


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """``text`` without ranges of words; of the blanks on both sides those stay that break a line."""
    at = [m.span() for m in WORD.finditer(text)]
    kept, done = [], 0
    for a, b in ranges:
        start, end = at[a][0], at[b - 1][1]
        left = at[a - 1][1] if a else 0
        right = at[b][0] if b < len(at) else len(text)
        if b == len(at) or (a and "\n" in text[end:right] and "\n" not in text[left:start]):
            start = left
        else:
            end = right
        kept.append(text[done:start])
        done = end
    return "".join([*kept, text[done:]])


def _cut(batches: Iterable[pa.RecordBatch], marks: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """Rows with what went in place of the columns ``marks``: gone and repeated lines, starts of windows to cut and of repeated ones."""
    marked_as = marks
    for batch in (s for b in batches for s in slices(b)):
        texts, marks = batch.column("text"), [batch.column(c) for c in marked_as]
        marked = np.flatnonzero(np.any([np.asarray(pc.is_valid(m)) for m in marks], axis=0))
        cut = {int(i): _cut_text(texts[i].as_py(), *(m[i].as_py() or [] for m in marks), size=size) for i in marked}
        if any(changed for changed, *_ in cut.values()):
            texts = pa.array([cut[i][1] if i in cut else t for i, t in enumerate(texts.to_pylist())], texts.type)
        counts = np.zeros((3, batch.num_rows), dtype=np.int64)
        for i, (_, _, *own) in cut.items():
            counts[:, i] = own
        names = [c for c in batch.schema.names if c not in marked_as]
        columns = [texts if c == "text" else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[0], pa.int32()), pa.array(counts[1]), pa.array(counts[2])], names=[*names, "n_spans", "n_span_words", "n_repeat_words"])


def _cut_text(text: str, gone: list[int], repeated: list[int], starts: list[int], again: list[int], size: int) -> tuple[bool, str, int, int, int]:
    """(whether it changed, the text left, spans cut, their words, words that repeat)."""
    if text is None:
        return False, text, 0, 0, 0
    lines = text.split("\n")
    words = np.concatenate([[0], np.cumsum([len(WORD.findall(line)) for line in lines])])
    held = np.zeros(words[-1], dtype=bool)
    for line in repeated:
        held[words[line] : words[line + 1]] = True
    for a, b in spans(again, size):
        held[a:b] = True
    if not gone and not starts:
        return False, text, 0, 0, int(held.sum())
    left, lost = set(gone), np.zeros(len(lines), dtype=np.int64)
    for line in left:
        lost[line] = words[line + 1] - words[line]
    before = np.concatenate([[0], np.cumsum(lost)])
    line_of = np.searchsorted(words, starts, side="right") - 1
    ranges = spans([int(s - before[line]) for s, line in zip(starts, line_of)], size)  # places in the lines left
    kept = "\n".join(line for i, line in enumerate(lines) if i not in left)
    return True, without(kept, ranges) if ranges else kept, len(ranges), sum(b - a for a, b in ranges), int(held.sum())


def place(within: Column) -> Column:
    """What orders places by doc_id, ``within`` and, where there is no doc_id, by ``_row``; equal for rows of one doc_id."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.when(F.col("doc_id").isNull(), F.col("_row")).otherwise(0).alias("own"), within.alias("within"))


def repeated_windows(texts: DataFrame, keyed: DataFrame, gone: DataFrame, size: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(_row, starts, again, firsts): windows of ``texts`` (_row, doc_id, text) that occurred before; those that occur elsewhere; doc_ids that hold them first.

    ``keyed`` (_row, keys, key_lines) has each text's window keys and the lines that these are in,
    ``gone`` (_row, gone) lines that are taken out; windows that touch them don't count.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    gone = gone.filter(F.size("gone") > 0)
    each = keyed.join(gone, "_row", "left").select("_row", "gone", F.explode(F.arrays_zip("keys", "key_lines")).alias("own"))
    each = each.filter(F.col("gone").isNull() | ~F.array_contains("gone", F.col("own.key_lines"))).select("_row", F.col("own.keys").alias("key"))
    each = materialize(each, "window-keys")
    twice = each.groupBy("key").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("key")
    marked = materialize(each.join(twice, "key").groupBy("_row").agg(F.collect_set("key").alias("keys")), "repeated-keys")
    drop_all(each)
    found = texts.join(marked, "_row").join(gone, "_row", "left").select("_row", "doc_id", "text", "keys", "gone")
    listed = materialize(found.mapInArrow(partial(_listed, size=size, gram=min(gram, size)), f"key long, hash long, _row long, doc_id {kind}, at long"), "windows")
    drop_all(marked)
    here = place(F.col("at"))
    first = listed.groupBy("key", "hash").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter(F.col("first") != F.col("last"))
    first = materialize(first, "first-windows")  # written, so that the join with windows of very many texts can be split
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("doc_id").isNotNull() | (F.col("_row") == F.col("first.own")))
    later = ~same | (F.col("at") - F.col("first.within") >= size)
    apart = (F.col("first.doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("first.own") == F.col("last.own"))) == F.lit(False)
    held = listed.join(first, ["key", "hash"]).select("_row", "at", later.alias("later"), apart.alias("apart"), F.col("first.doc_id").alias("holder"))
    cut = F.when(F.col("later"), F.col("at").cast("int"))
    found = held.groupBy("_row").agg(F.collect_set(cut).alias("starts"), F.collect_set(F.when(F.col("later") | F.col("apart"), F.col("at").cast("int"))).alias("again"), F.collect_set(F.when(F.col("later"), F.col("holder"))).alias("firsts"))
    found = materialize(found, "repeated-windows")
    drop_all(listed)
    drop_all(first)
    return found


def cut_rows(whole: DataFrame, marks: DataFrame, names: list[str], number: str, size: int = WORDS) -> DataFrame:
    """Columns ``names`` of ``whole`` with what ``marks`` (_row, gone, repeated, holders, starts, again, firsts, n_paragraphs) tells of taken out, and what went beside."""
    told, told_row, *lists = fresh_names([*names, number], "told", "told_row", "gone", "repeated", "starts", "again")
    none = F.array().cast(marks.schema["holders"].dataType)
    holders = F.array_sort(F.array_union(F.coalesce("holders", none), F.coalesce("firsts", none)))
    some = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("gone", "repeated", "starts", "again")]
    own = F.struct("n_paragraphs", F.size(F.coalesce("gone", F.array().cast("array<int>"))).alias("n_removed"), holders.alias("holders"), *some)
    both = whole.join(marks.select(F.col("_row").alias(told_row), own.alias(told)), F.col(number) == F.col(told_row), "left")
    field = lambda name: F.col(f"{told}.{name}")
    added = [F.coalesce(field("n_paragraphs"), F.lit(0)).alias("n_paragraphs"), F.coalesce(field("n_removed"), F.lit(0)).alias("n_removed"), F.coalesce(field("holders"), none).alias("first_doc_ids")]
    rows = both.select(*[F.col(c) for c in names], *added, *[field(c).alias(as_) for c, as_ in zip(("gone", "repeated", "starts", "again"), lists)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in lists]
    return rows.mapInArrow(partial(_cut, marks=lists, size=size), ", ".join([*fields, "n_spans int", "n_span_words long", "n_repeat_words long"]))

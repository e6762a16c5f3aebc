"""Search by an inverted index: trigrams of folded paths fetch candidates, and only those are folded again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.operators import library
from heliograph.scratch import folder, written

GRAM = 3

#: Postings in a part, about. A gram of more is dealt to several parts, since they are ranges of (gram, id).
ROWS = 2_000_000

#: Grams of a token whose postings are intersected, the rarest first.
INTERSECTED = 3


@dataclass(frozen=True)
class Segment:
    """Postings (gram, id) in folders of consecutive ranges, and the first and last gram of each."""

    path: str
    parts: DataFrame


@dataclass(frozen=True)
class SearchIndex:
    """Segments, the oldest first. Postings of a path that a photo no longer has only cost a candidate."""

    segments: tuple[Segment, ...]


def grams(text: Column) -> Column:
    """Distinct runs of three characters, in one pass over the text; none in shorter ones, null for null.

    Beyond the basic plane some runs more are given, which only cost candidates.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _segment(photos: DataFrame, per_part: int) -> Segment:
    spark = photos.sparkSession
    rows = written(photos.select(F.explode(grams(S.fold(F.col("path")))).alias("gram"), "id").distinct(), "postings")
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // per_part)), "gram", "id").withColumn("part", F.spark_partition_id())
    path = f"{folder(spark)}/heliograph/postings-{uuid.uuid4().hex}"
    dealt.sortWithinPartitions("gram", "id").write.mode("overwrite").partitionBy("part").parquet(path)
    held = spark.read.schema("gram string, id long, part int").parquet(path)
    parts = held.groupBy("part").agg(F.min("gram").alias("first"), F.max("gram").alias("last"))
    return Segment(path, written(parts, "postings-parts"))


def build(photos: DataFrame, per_part: int = ROWS) -> SearchIndex:
    """An index of all paths of ``photos`` (id, path)."""
    return SearchIndex((_segment(photos, per_part),))


def extend(index: SearchIndex, changed: DataFrame, per_part: int = ROWS) -> SearchIndex:
    """The index after photos came or were renamed, as one more segment; removed ones need nothing.

    ``build`` over the current photos drops what has become stale.
    """
    return replace(index, segments=(*index.segments, _segment(changed, per_part)))


def postings(index: SearchIndex, wanted: list[str]) -> DataFrame | None:
    """(gram, id) of some grams, from the parts that may hold them; None where no part does."""
    found = []
    for segment in index.segments:
        spark = segment.parts.sparkSession
        may = reduce(lambda a, b: a | b, [(F.col("first") <= g) & (F.col("last") >= g) for g in wanted])
        parts = [r["part"] for r in segment.parts.filter(may).select("part").orderBy("part").collect()]  # parts of one token's grams
        if parts:
            read = spark.read.schema("gram string, id long").parquet(*[f"{segment.path}/part={p}" for p in parts])
            found.append(read.filter(F.col("gram").isin(wanted)))
    return reduce(DataFrame.unionByName, found) if found else None


def candidates(index: SearchIndex, token: str) -> DataFrame | None:
    """(id): photos whose path may hold a folded token; None where the index can't tell.

    Only tokens of three characters or more have grams. A gram without postings means that no path
    holds the token. The rarest grams are intersected; the others are left to the verification.
    """
    wanted = sorted({token[at : at + GRAM] for at in range(len(token) - GRAM + 1)})
    if not wanted:
        return None
    rows = postings(index, wanted)
    if rows is None:
        return index.segments[0].parts.filter("false").select(F.col("part").cast("long").alias("id"))
    counts = {r["gram"]: r["n"] for r in rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a gram of the token
    if len(counts) < len(wanted):
        return rows.filter("false").select("id")
    rarest = sorted(wanted, key=lambda g: (counts[g], g))[:INTERSECTED]
    bit = reduce(lambda other, at: other.when(F.col("gram") == rarest[at], 1 << at), range(1, len(rarest)), F.when(F.col("gram") == rarest[0], 1))
    held = rows.filter(F.col("gram").isin(rarest)).groupBy("id").agg(F.bit_or(bit).alias("held"))
    return written(held.filter(F.col("held") == (1 << len(rarest)) - 1).select("id"), "candidates")


def on_path(photos: DataFrame, index: SearchIndex, folded: str) -> DataFrame:
    """(id): photos whose folded path holds a folded token; only candidates are folded."""
    may = candidates(index, folded)
    rows = photos.select("id", "path") if may is None else photos.select("id", "path").join(may, "id", "left_semi")
    return rows.filter(F.contains(S.fold(F.col("path")), F.lit(folded))).select("id")


def search(index: SearchIndex, photos: DataFrame, query: str | None, faces: DataFrame, identities: DataFrame) -> DataFrame:
    """What ``library.search`` gives, with paths looked up in the index.

    The index has to know the current path of every photo. A null path is matched by no token of
    letters, only by its person, month or year; ids are unique.
    """
    for token in (query or "").split():
        folded = S.fold_literal(token)
        date = S.when_of(S.sort_ts())
        if folded.lstrip("+-").isdigit() and 1900 <= int(folded) <= 2100:
            photos = photos.filter(F.year(date) == int(folded))
            continue
        hits = on_path(photos, index, folded).unionByName(library.pictured(faces, identities, folded)).distinct()
        month = S.month_number(folded)
        if not month:
            photos = photos.join(hits, "id", "left_semi")
            continue
        flagged = photos.join(hits.withColumn("_hit", F.lit(True)), "id", "left")
        photos = flagged.filter(F.coalesce("_hit", F.lit(False)) | (F.month(date) == month)).drop("_hit")
    return photos

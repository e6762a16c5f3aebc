"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations.

Every window of an item (ten words, or all words of a shorter item) is a set of word shingles
that a document must contain whole. Overlap must be total, so the necessary prefix of a
window, with its shingles ordered from the rarest on, is one shingle. One pass over the
documents finds the places of benchmark shingles; how often they occur there is the rarity.
Places then join windows on their prefix shingle alone, bounds on position and length drop
windows that would begin before or end after the document, and the words around the place are
compared with the window's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.storage import fresh_names, materialize
from heliograph.llm.words import BROADCAST_ROWS, gram_hash, small_side, words

WINDOW = 10
SHINGLE = 5


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: words, n, and the items that have them. Items without words have none."""
    cut = items.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window)))
    starts = cut.select("item_id", "words", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("start"))
    each = starts.select("item_id", "n", F.slice("words", F.col("start"), F.col("n")).alias("window"))
    return each.groupBy("window", "n").agg(F.collect_set("item_id").alias("items"))


def _places(docs: DataFrame, shingles: DataFrame, sizes: list[int], reach: int, few: bool) -> DataFrame:
    """(row, doc_id, n_words, at, size, hash, around): places of benchmark shingles, and each document's last word.

    ``around`` holds the words from ``reach`` before the place to ``reach`` + size after it. Where
    the shingles aren't few, only that, and not the document's words, meets them in a shuffle.
    """
    cut = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    at = cut.select("row", "doc_id", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("at", "word")).drop("word")
    first = F.greatest(F.col("at") - reach, F.lit(0))
    around = lambda size: F.slice("words", first + 1, F.col("at") - first + size + reach)
    last = F.col("at").isNull() | (F.col("at") == F.col("n_words") - 1)
    if len(sizes) == 1:
        hashed = at.withColumns({"size": F.lit(sizes[0]), "hash": gram_hash("words", "at", sizes[0])})
    else:
        each = F.array(*[F.struct(F.lit(size).alias("size"), gram_hash("words", "at", size).alias("hash")) for size in sizes])
        hashed = at.withColumn("gram", F.explode(each)).select(*at.columns, "gram.*")
    if not few:
        hashed = hashed.withColumn("around", around(F.col("size"))).drop("words")
    found = hashed.join(shingles, ["size", "hash"], "left").filter(F.col("known") | (last & (F.col("size") == sizes[0])))
    beside = around(F.col("size")) if few else F.col("around")
    return found.select("row", "doc_id", "n_words", "at", "size", F.when(F.col("known"), F.col("hash")).alias("hash"), F.when(F.col("known"), beside).alias("around"), (last & (F.col("size") == sizes[0])).alias("last"))


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(documents: row, doc_id, n_words; hits: row, start, n, items), each place of a window once.

    One pass over the documents numbers them and finds the shingles of all sizes, and is written
    down, so that a row's number is the same in all that follows.
    """
    windows = materialize(benchmark_windows(items, window).withColumns({"window_id": F.monotonically_increasing_id(), "size": F.least("n", F.lit(shingle))}), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [shingle]  # at most ``shingle``
    at = windows.select("window_id", "window", "n", "items", "size", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))).alias("offset"))
    hashed = F.coalesce(*[F.when(F.col("size") == size, gram_hash("window", "offset", size)) for size in sizes])
    grams = materialize(at.withColumn("hash", hashed), "window-shingles")
    known = grams.select("size", "hash", F.lit(True).alias("known")).distinct()
    n_known, reach = known.count(), window - min(sizes)
    places = materialize(_places(docs, small_side(known, n_known), sizes, reach, n_known <= BROADCAST_ROWS), "places")
    documents, found = places.filter("last").select("row", "doc_id", "n_words"), places.filter(F.col("hash").isNotNull())
    rarity = found.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("places"))
    ranked = grams.join(rarity, ["size", "hash"])  # a window with a shingle that never occurs needs no candidates
    by_rarity = Window.partitionBy("window_id").orderBy("places", "hash", "offset")
    prefix = ranked.withColumn("rank", F.row_number().over(by_rarity)).withColumn("occurring", F.count(F.lit(1)).over(Window.partitionBy("window_id")))
    prefix = prefix.filter((F.col("rank") == 1) & (F.col("occurring") == F.col("n") - F.col("size") + 1)).select("size", "hash", "window", "n", "items", "offset")
    prefix = materialize(prefix, "prefix-shingles")
    start = F.col("at") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    inside = F.slice("around", start - F.greatest(F.col("at") - reach, F.lit(0)) + 1, F.col("n"))
    candidates = found.join(small_side(prefix), ["size", "hash"]).filter(bounds)
    return documents, candidates.filter(inside == F.col("window")).select("row", start.alias("start"), "n", "items")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    A word is hit if any occurrence of an item's window covers it. Null and wordless texts have
    no words and no hits; null or wordless items have no windows; an item without an id counts
    for hits, but not as an item. Equal items are one window each with all their ids. Repeated
    rows keep a row each, an empty table gives none, and other columns are ignored.
    """
    documents, hits = find_windows(docs, items, window, shingle)
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda i: i.cast("string")))
    by_row = hits.groupBy("row").agg(F.size(covered).cast("long").alias("n_hit"), ids.alias("items"))
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return documents.join(by_row, "row", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Rows of ``docs`` that hold no window. Each row is judged by its own text, whatever its doc_id.

    Null and empty texts hold none and stay; repeated rows share a fate; an empty table gives no rows.
    """
    tag, = fresh_names(docs.columns, "tag")
    found = decontaminate(docs.select(F.xxhash64("text").alias("doc_id"), "text"), items, window, shingle)
    found = materialize(found.filter("contaminated").select(F.col("doc_id").alias(tag)).distinct(), "contaminated")
    return docs.withColumn(tag, F.xxhash64("text")).join(found, tag, "left_anti").select(*docs.columns)

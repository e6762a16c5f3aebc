"""Line deduplication as an exact set-similarity join, in DataFrame operations.

A line is the set of its words; a class is all lines of one text, known by 128 bits of hashes.

1. Words are counted over the whole corpus. A table of RARITY_BUCKETS levels by a word's hash, which
   holds the most frequent words and is bounded whatever the vocabulary, orders them from the rarest on.
2. Every class is written once: its place, size, the prefix of its rarest words, and the parity of its
   words in 64 bits, or in 256 if it has more than NARROW words. Every word in which two sets differ
   changes one bit, so that the number of bits in which their parities differ is a lower bound of their
   symmetric difference; long lines need more bits for it to tell them apart.
3. Stars: classes that agree on a sketch of their rarer words are compared with the earliest of them.
   That settles most members of large groups of near copies without their pairs being made.
4. The join: classes meet on prefix words. The first word that two similar sets share has so few words
   before it in either that the rest still holds the overlap needed; a pair is made only on words at
   such places, under the bounds on length and parity, and only if the later of the two isn't settled yet.
5. The Jaccard similarity of all pairs made is verified on the words themselves.

A line goes if its class has an earlier line, or if an earlier class is similar to its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.storage import drop_all, fresh_names, materialize

SIMILARITY = 0.8
#: Levels in the rarity table, which is broadcast: 1 MiB. At most half of them are of words told apart.
RARITY_BUCKETS = 1 << 20
#: 64-bit words of the bitmap of wanted classes, which is broadcast: 256 KiB.
MARK_WORDS = 1 << 15
#: Parts by word in which the join is made, one after another, so that prefix words take less disk at once.
PARTS = 3
LEVEL_SHIFT = 56  # a coded word: its level above, hash bits below
BLOCK = 4096
PLACE = ("doc_id", "tag", "line_no")
#: Sets up to this size have 64 bits of parity, larger ones four times as many.
NARROW = 48
PARITIES = ("p0", "p1", "p2", "p3")


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def line_words(line: Column) -> Column:
    """Lower-case words of a line, separated by blanks."""
    return F.array_remove(F.split(F.lower(line), " "), "")


def _tag(text: Column) -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(text)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, line_no, line, k0, k1) of every line with a word."""
    own = docs.select("doc_id", _tag(F.col("text")).alias("tag"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return own.filter(F.trim("line") != "").withColumns({"k0": F.xxhash64("line"), "k1": F.xxhash64(F.lit(1), "line")})


def _dense(rows: DataFrame, size: int) -> DataFrame:
    """One row with the array ``cells`` of ``size`` longs from (cell, value) rows, 0 where there is none.

    ``size`` bounds what comes together here and is broadcast.
    """
    spark = rows.sparkSession
    filled = rows.union(spark.range(size).select(F.col("id").cast("int"), _long(0))).toDF("cell", "value")
    blocks = filled.groupBy("cell").agg(F.bit_or("value").alias("value")).groupBy(F.floor(F.col("cell") / BLOCK).alias("block")).agg(F.collect_list(F.struct("cell", "value")).alias("held"))
    parts = blocks.select("block", F.transform(F.array_sort("held"), lambda c: c["value"]).alias("cells"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "cells"))), lambda b: b["cells"]))
    return parts.groupBy().agg(whole.alias("cells"))


def rarity_levels(docs: DataFrame) -> DataFrame:
    """One row with the level of every bucket of words: 0 if no word there occurs twice.

    A word's level is 1 if it occurs twice or more and not often enough for the table, which has
    room for as many of the most frequent words as half its buckets, else 2 + 2.5 x the binary
    logarithm of its count. A bucket has the highest level of its words, so it never understates one.
    """
    word = docs.select(F.explode(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counted = word.groupBy(F.xxhash64("word").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    level = F.least(2 + F.floor(2.5 * F.log2("n")), F.lit(127)).cast("int")
    counted = materialize(counted.select(_bucket(F.col("word")).alias("bucket"), level.alias("level")), "word-levels")
    room, floor = RARITY_BUCKETS // 2, 128
    for row in sorted(counted.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # 127 rows at most
        room -= row["count"]
        if room < 0:
            break
        floor = row["level"]
    told = F.when(F.col("level") < floor, 1).otherwise(F.col("level"))
    best = counted.groupBy("bucket").agg(F.max(told).cast("long").alias("level"))
    table = materialize(_dense(best, RARITY_BUCKETS).select(F.col("cells").cast("array<tinyint>").alias("cells")), "rarity")
    drop_all(counted)
    return table


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(_long(RARITY_BUCKETS - 1)).cast("int")


def _parity(words: Column) -> Column:
    """64 bits: of how many words with each value of the lowest six bits the number is odd."""
    return F.aggregate(words, _long(0), lambda bits, w: bits.bitwiseXOR(F.call_function("shiftleft", _long(1), w.bitwiseAND(_long(63)).cast("int"))))


def _parities(words: Column) -> list[Column]:
    """PARITIES: of more than NARROW words, those of each value of the next two bits apart; else of all, and zeros.

    Either way their exclusive or is the parity of all words.
    """
    wide = F.size(words) > NARROW
    part = lambda k: F.filter(words, lambda w: w.bitwiseAND(_long(192)) == _long(64 * k))
    return [F.when(wide, _parity(part(k))).otherwise(_long(0) if k else _parity(words)).alias(c) for k, c in enumerate(PARITIES)]


def line_classes(docs: DataFrame, levels: DataFrame, similarity: float) -> DataFrame:
    """(id, k0, k1, first: the earliest place, n, prefix, PARITIES, s0, s1) of every class, written down."""
    hashed = _lines(docs).withColumn("hashed", F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w))).withColumn("levels", levels.scalar())
    level = lambda h: F.coalesce(F.get("levels", _bucket(h)), F.lit(0).cast("tinyint")).cast("long")
    code = lambda h: F.shiftleft(level(h), LEVEL_SHIFT).bitwiseOR(F.shiftrightunsigned(h, 64 - LEVEL_SHIFT))
    coded = hashed.select("k0", "k1", *PLACE, F.sort_array(F.array_distinct(F.transform("hashed", code))).alias("words"))
    n = F.size("words")
    length = n - F.ceil(n * F.lit(similarity) - 1e-9).cast("int") + 1
    # A sketch is of the rarer half, so that words of very many lines aren't one.
    half = F.transform(F.slice("words", 1, F.ceil(n / 2).cast("int")), lambda w: w.bitwiseAND(_long((1 << LEVEL_SHIFT) - 1)))
    sized = coded.select("k0", "k1", *PLACE, n.alias("n"), F.slice("words", 1, length).alias("prefix"), *_parities(F.col("words")), half.alias("half"))
    own = sized.select("k0", "k1", F.struct(F.struct(*PLACE).alias("first"), "n", "prefix", *PARITIES, F.array_min("half").alias("s0"), F.array_max("half").alias("s1")).alias("own"))
    classes = own.groupBy("k0", "k1").agg(F.min("own").alias("own")).select("k0", "k1", "own.*")
    return materialize(classes.withColumn("id", F.monotonically_increasing_id()), "line-classes")


def _overlap(n: Column, m: Column, similarity: float) -> Column:
    """The least overlap of similar sets of these sizes."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (n + m) - 1e-9)


def _possible(a: str, b: str, similarity: float) -> Column:
    """Whether length and parity let the sets of columns with these prefixes be similar."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    bits = [F.col(a + p).bitwiseXOR(F.col(b + p)) for p in PARITIES]
    apart = reduce(Column.__add__, map(F.bit_count, bits))
    differ = F.when((n > NARROW) == (m > NARROW), apart).otherwise(F.bit_count(reduce(Column.bitwiseXOR, bits)))
    return (F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - 1e-9) & (differ <= n + m - 2 * _overlap(n, m, similarity))


def _named(prefix: str, *names: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in names]


def star_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of classes that may be similar: the earliest with each sketch, and others with it."""
    held = ("id", "n", *PARITIES)
    sketched = classes.select(F.explode(F.array("s0", "s1")).alias("sketch"), "first", *held)
    centre = sketched.groupBy("sketch").agg(F.min(F.struct("first", *held)).alias("centre"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    centre = centre.select("sketch", *[F.col(f"centre.{c}").alias(f"a_{c}") for c in held])
    met = centre.join(sketched.select("sketch", *_named("b_", *held)), "sketch")
    return met.filter((F.col("a_id") != F.col("b_id")) & _possible("a_", "b_", similarity)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def prefix_pairs(classes: DataFrame, settled: DataFrame, similarity: float, part: int) -> DataFrame:
    """(a, b) of classes that share a prefix word where similar sets' first shared one can be, and may be similar.

    Words of one of PARTS are judged. ``a`` is the smaller one, which needs a shorter prefix. Words that stand in one line only are
    left out, and pairs whose later class is settled: by doc_id, or if that is the same, both.
    """
    known = classes.join(settled.withColumn("settled", F.lit(True)), "id", "left")
    held = ("id", "n", "at", "settled", "doc", *PARITIES)
    cut = lambda prefix: known.select("id", "n", F.coalesce("settled", F.lit(False)).alias("settled"), F.col("first.doc_id").alias("doc"), *PARITIES, F.posexplode(prefix).alias("at", "word")).filter((F.col("word") >= F.shiftleft(_long(1), LEVEL_SHIFT)) & (F.pmod("word", F.lit(PARTS)) == part))
    n = F.col("n")
    short = F.slice("prefix", 1, (n - _overlap(n, n, similarity) + 1).cast("int"))
    a, b = (cut(prefix).select("word", *_named(side, *held)) for side, prefix in (("a_", short), ("b_", F.col("prefix"))))
    n, m = F.col("a_n"), F.col("b_n")
    ordered = (n < m) | ((n == m) & (F.col("a_id") < F.col("b_id")))
    overlap = _overlap(n, m, similarity)
    early = (F.col("a_at") <= n - overlap) & (F.col("b_at") <= m - overlap)
    earlier = lambda x, y: F.coalesce(F.col(x) < F.col(y), F.col(x).isNull() & F.col(y).isNotNull())
    open_ = F.when(earlier("a_doc", "b_doc"), ~F.col("b_settled")).when(earlier("b_doc", "a_doc"), ~F.col("a_settled")).otherwise(~(F.col("a_settled") & F.col("b_settled")))
    met = a.join(b, "word").filter(ordered & (n >= F.lit(similarity) * m - 1e-9) & early & open_ & _possible("a_", "b_", similarity))
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def later_classes(docs: DataFrame, places: DataFrame, pairs: DataFrame, settled: DataFrame | None, similarity: float) -> DataFrame:
    """(id) of classes in ``pairs`` that are similar to an earlier class of theirs, by their words; ``settled`` ones aren't asked.

    Of each class one pair is verified first, and the others only if that settles nothing.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = materialize(places.join(ids, "id", "left_semi"), "wanted-classes")
    # A bitmap of hashed keys keeps most other lines out of the shuffle.
    cell = lambda key: F.shiftrightunsigned(key, 6).bitwiseAND(_long(MARK_WORDS - 1)).cast("int")
    bit = lambda key: F.call_function("shiftleft", _long(1), key.bitwiseAND(_long(63)).cast("int"))
    marks = materialize(_dense(wanted.select(cell(F.col("k0")), bit(F.col("k0"))), MARK_WORDS), "wanted-marks")
    some = _lines(docs).withColumn("marks", marks.scalar()).filter(F.get("marks", cell(F.col("k0"))).bitwiseAND(bit(F.col("k0"))) != 0)
    texts = some.groupBy("k0", "k1").agg(F.min("line").alias("line"))
    sets = materialize(wanted.join(texts, ["k0", "k1"]).select("id", "line"), "wanted-lines")  # shorter than their words apart

    placed = pairs.join(wanted.select(*_named("a_", "id", "first")), F.col("a") == F.col("a_id")).join(wanted.select(*_named("b_", "id", "first")), F.col("b") == F.col("b_id"))
    swap = F.col("a_first") > F.col("b_first")
    asked = placed.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("earlier"))
    asked = materialize(asked if settled is None else asked.join(settled, "id", "left_anti"), "asked-pairs")
    found = []
    for step in (lambda: asked.groupBy("id").agg(F.min("earlier").alias("earlier")), lambda: asked.join(found[0], "id", "left_anti")):
        own = step().join(sets, "id").withColumnRenamed("line", "own")
        met = own.join(sets.withColumnRenamed("id", "earlier"), "earlier")
        met = met.select("id", F.array_distinct(line_words(F.col("own"))).alias("own"), F.array_distinct(line_words(F.col("line"))).alias("words"))
        both = F.size(F.array_intersect("own", "words"))
        met = met.filter(both >= F.lit(similarity) * (F.size("own") + F.size("words") - both) - 1e-9)
        found.append(materialize(met.select("id").distinct(), "later-classes"))
    later = materialize(found[0].union(found[1]), "later-classes")
    for done in (wanted, marks, sets, asked, *found):
        drop_all(done)
    return later


def first_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tag, line_no) of every line with words that no earlier one, by these three, matches."""
    docs = docs.select("doc_id", "text")
    levels = rarity_levels(docs)
    classes = line_classes(docs, levels, similarity)
    drop_all(levels)
    places = materialize(classes.select("id", "k0", "k1", "first"), "class-places")
    stars = materialize(star_pairs(classes, similarity), "star-pairs")
    settled = [later_classes(docs, places, stars, None, similarity)]
    met = [materialize(prefix_pairs(classes, settled[0], similarity, part), "prefix-pairs") for part in range(PARTS)]
    drop_all(classes)
    settled.append(later_classes(docs, places, reduce(DataFrame.union, met).distinct(), settled[0], similarity))
    for done in (stars, *met):
        drop_all(done)
    kept = places.join(reduce(DataFrame.union, settled), "id", "left_anti").select("first.*")
    kept = materialize(kept, "first-lines")
    for done in (places, *settled):
        drop_all(done)
    return kept


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with later matching lines taken out of ``text``, and n_lines and n_removed beside.

    A line goes if any earlier line of the table, by (doc_id, hash of the text, line number), has
    a word set of Jaccard ``similarity`` or more to its own; the earlier one need not stay itself.
    Rows without a doc_id come first. Rows of one doc_id with different texts are documents of
    their own; repeated rows share their lines' fate. Lines without words stay and match nothing.
    A null text stays null with no lines; an empty one has one line; an empty table gives no
    rows. With ``drop_emptied`` rows go that had words and have lost all lines that held any.
    Columns named n_lines and n_removed are replaced; any other name may occur in ``docs``.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    tag, left_id, left_tag, left = fresh_names(docs.columns, "tag", "left_id", "left_tag", "left")
    kept = first_lines(docs, similarity).groupBy("doc_id", "tag").agg(F.collect_list("line_no").alias(left))
    kept = kept.withColumnsRenamed({"doc_id": left_id, "tag": left_tag})
    own = docs.select(*names, _tag(F.col("text")).alias(tag))
    joined = own.join(kept, F.col("doc_id").eqNullSafe(F.col(left_id)) & (F.col(tag) == F.col(left_tag)), "left")
    lines = F.split("text", "\n")
    stay = F.coalesce(F.col(left), F.array().cast("array<int>"))
    worded = F.size(F.filter(lines, lambda line: F.trim(line) != ""))
    n_removed = F.greatest(worded, F.lit(0)) - F.size(stay)
    text = F.array_join(F.filter(lines, lambda line, i: (F.trim(line) == "") | F.array_contains(stay, i)), "\n")
    if drop_emptied:
        joined = joined.filter(F.col(left).isNotNull() | F.coalesce(F.translate("text", " \n", "") == "", F.lit(True)))
    columns = [F.when(n_removed > 0, text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in names]
    return joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), n_removed.alias("n_removed"))

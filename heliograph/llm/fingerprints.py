"""SpotSigs document fingerprints in DataFrame operations.

Common words are anchors. The content words that follow an anchor, whatever anchors stand in
between, form a chain, and the set of a document's hashed chains is its fingerprint. Sets are compared by Jaccard similarity;
where a floor is given, sets whose lengths alone keep them below it are not intersected.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.storage import drop, materialize
from heliograph.llm.words import LOWER, UPPER, small_side

# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "the of and to a in is that it for on was as with be by are this at an from or "
    "de la le les des et en un une du que qui dans pour sur au par ne pas "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch "
    "el los las y del se por con para su al lo como"
).split()
CHAIN = 2
#: What is put between an anchor and the word after it, and at a text's end; in texts they are blanks.
GLUE, END = "\x01", "\x02"
#: Buckets of chains whose frequencies order them for the join.
LEVEL_BUCKETS = 1 << 16
#: Each class has the chain that is nearest to each of these by exclusive or as a sketch.
SKETCHES = (0x3C6EF372FE94F82B, 0x510E527FADE682D1, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
#: Classes that share a sketch, from which on they are a group with a centre.
GROUP = 8
#: Classes belong to a centre up to this many times the distance at which they are linked with it.
FAR = 2
#: Buckets of consecutive doc_ids for each shuffle partition, so that uneven hashing evens out.
BUCKETS_PER_PARTITION = 4


def _plain(text: Column) -> Column:
    """A-Z lowered, other white space as blanks, and other ASCII signs left out."""
    signs = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    return F.translate(text, f"{UPPER}\n\t\r\f\v{GLUE}{END}" + signs, LOWER + " " * 7)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for all its uses there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chains(text: Column, chain: int = CHAIN) -> Column:
    """Sorted set of hashed chains: each anchor with the next ``chain`` content words after it.

    Anchors with fewer content words after them have no chain. The text's beginning is an anchor
    too; in a text of fewer content words its chain is of those, and in one of anchors alone
    of these. A text without words has no chains.
    """
    anchor = "|".join(sorted(set(ANCHORS)))
    plain = F.concat(F.regexp_replace(F.trim(_plain(text)), " +", " "), F.lit(f" {END}"))
    # Content words, each with the anchors right before it glued on, and the end.
    words = F.filter(F.split(F.regexp_replace(plain, f"(?<![^ ])({anchor}) ", f"$1{GLUE}"), " "), lambda w: w != "")
    hashed = F.xxhash64
    none = F.array().cast("array<bigint>")

    def of_words(words: Column, content: Column) -> Column:
        last = F.size(words) - 1
        follow = lambda k: F.array_join(F.slice(content, k + 1, F.lit(chain)), " ")
        before = lambda w: F.filter(F.split(w, GLUE), lambda a, i: i < F.size(F.split(w, GLUE)) - 1)
        own = lambda w, k: F.when(w.contains(GLUE) & (k + chain <= last), F.transform(before(w), lambda a: hashed(a, follow(k)))).otherwise(none)
        first = F.when(last > 0, F.array_join(F.slice(content, F.lit(1), F.least(last, F.lit(chain))), " ")).otherwise(F.get(words, F.lit(0)))
        return F.concat(F.flatten(F.transform(words, own)), F.when(first == END, none).otherwise(F.array(hashed(F.lit(""), first))))

    found = _let(words, lambda ws: _let(F.transform(ws, lambda w: F.substring_index(w, GLUE, -1)), lambda content: of_words(ws, content)))
    return F.sort_array(F.array_distinct(found))


def render(signature: Column) -> Column:
    """A fingerprint as text: sixteen hexadecimal digits a chain."""
    return F.array_join(F.transform(signature, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two chain sets; equal sets, empty ones included, give 1.

    With a floor, pairs that length alone keeps below it count as 0 without being intersected.
    """
    few, many = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    return F.when(a == b, 1.0).when((few == 0) | (few < F.lit(floor) * many), 0.0).otherwise(exact)


def with_next(docs: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Every row of (doc_id, text) and columns derived from them, with ``next_<column>`` of the row that follows, the last with the first's.

    Rows are dealt to many buckets of consecutive ids; each bucket also gets a copy of the row
    that begins the next one, so that no global order in one task is needed. Only texts are
    shuffled; columns are derived from them where they arrive.
    """
    carried = ["text", *derived]
    spark = docs.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    shares = [i / wanted for i in range(1, wanted)]
    edges = docs.agg(F.percentile_approx("doc_id", shares, 10 * wanted).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    listed = F.from_json(F.lit(str(edges)), "array<bigint>")
    bucket = F.size(F.filter(listed, lambda e: e <= F.col("doc_id"))) if edges else F.lit(0)
    bucketed = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket))  # nulls come first
    firsts = {r["bucket"]: r["doc_id"] for r in bucketed.groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).collect()}  # a row a bucket
    order = sorted(firsts)
    if not order:
        return docs.withColumns(derived).select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    before = [(firsts[b], order[i - 1] if i else order[-1]) for i, b in enumerate(order)]
    heads = spark.createDataFrame(before, "doc_id long, bucket int")
    first_ids = [d for d, _ in before if d is not None]
    wanted_rows = F.col("doc_id").isin(first_ids) | (F.col("doc_id").isNull() if None in firsts.values() else F.lit(False))
    begin = docs.filter(wanted_rows).groupBy("doc_id").agg(F.min("text").alias("text"))
    begin = begin.join(F.broadcast(heads), begin["doc_id"].eqNullSafe(heads["doc_id"])).select(begin["doc_id"], "bucket", "text")
    both = bucketed.withColumn("ghost", F.lit(False)).unionByName(begin.withColumn("ghost", F.lit(True)), allowMissingColumns=True)
    follow = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "text")
    moved = both.repartition("bucket").withColumns(derived).select("*", F.lead(F.struct(*carried)).over(follow).alias("following"))
    return moved.filter(~F.col("ghost")).select("*", *[F.col(f"following.{c}").alias(f"next_{c}") for c in carried]).drop("bucket", "ghost", "following")


def fingerprint_documents(docs: DataFrame, chain: int = CHAIN, threshold: float = 0.8) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text, likenesses, classes and links.

    The edited text has its last quarter (n_chars div 4 code points) replaced by as many of the
    first of the next row's, or all if it has fewer. A null text is empty, and its fingerprint
    too. Rows of equal doc_id follow each other by text. Repeated rows keep a row each; an
    empty table gives no rows; other columns are ignored; a single row follows itself.

    ``class_id`` is the smallest doc_id of the rows with this fingerprint, and ``n_links`` the
    number of other fingerprints at ``threshold`` or above, found by the length-partitioned join.
    A row without chains is its own class and linked with nothing.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(own, {"spots": chains(F.col("text"), chain)})
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 4) as int))"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "spots", "next_spots")
    rows = rows.withColumn("edited_spots", chains(F.col("edited"), chain))
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "spots",
        F.array_except("spots", "edited_spots").alias("gone"),
        F.array_except("edited_spots", "spots").alias("added"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        class_key(F.col("spots")).alias("key"),
    )
    prints = materialize(rows, "fingerprints")
    links = class_links(prints, threshold).filter("docs > 1 or n_links > 0").drop("docs")  # any other row is its own class
    edited_spots = F.sort_array(F.concat(F.array_except("spots", "gone"), "added"))  # most chains are of both texts
    return prints.join(small_side(links), "key", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        render(F.col("spots")).alias("fingerprint"),
        render(edited_spots).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def chain_levels(prints: DataFrame) -> DataFrame:
    """One row with ``cells``: for each bucket of chains about 2 x the binary logarithm of how often its chains occur.

    The order of chains by these is the same for all sets, which is all that prefixes need: a
    coarse one costs work, not results. ``LEVEL_BUCKETS`` bounds what comes together here.
    """
    spark = prints.sparkSession
    held = prints.select(F.explode("spots").alias("spot")).groupBy(_bucket(F.col("spot")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    filled = held.union(spark.range(LEVEL_BUCKETS).select("id", F.lit(0).cast("long"))).groupBy("bucket").agg(F.max("n").alias("n"))
    level = F.floor(2 * F.log2(F.col("n") + 1)).cast("tinyint")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("bucket", level.alias("level")))), lambda c: c["level"])
    return materialize(filled.groupBy().agg(cells.alias("cells")), "chain-levels")


def _bucket(spot: Column) -> Column:
    return spot.bitwiseAND(F.lit(LEVEL_BUCKETS - 1).cast("long"))


def _parity(spots: Column, at: int = 20) -> Column:
    """64 bits: for each value of the six bits of a chain from ``at`` on, whether an odd number of chains has it.

    Sets differ in as many chains at least as their parities in bits.
    """
    one = F.lit(1).cast("long")
    value = lambda s: F.shiftrightunsigned(s, at).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.aggregate(spots, F.lit(0).cast("long"), lambda bits, s: bits.bitwiseXOR(F.call_function("shiftleft", one, value(s))))


def _fine(spots: Column) -> Column:
    """256 bits in four numbers, the parities of the chains of each value of two further bits."""
    two = lambda s: F.shiftrightunsigned(s, 40).bitwiseAND(F.lit(3).cast("long"))
    part = lambda k: F.filter(spots, lambda s: two(s) == k)
    return F.array(*[_parity(part(k), 42) for k in range(4)])


def _shared(threshold: float) -> Column:
    """The least number of chains that similar sets of a_n and b_n chains share."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a_n") + F.col("b_n")) - 1e-9)


def sketches(spots: Column) -> Column:
    """The chain that is nearest to each of SKETCHES by exclusive or, with its bits turned so."""
    return F.array(*[F.array_min(F.transform(spots, lambda s, mask=mask: s.bitwiseXOR(F.lit(mask).cast("long")))) for mask in SKETCHES])


def class_key(spots: Column) -> Column:
    return F.unhex(F.md5(render(spots)))


def fingerprint_classes(prints: DataFrame, threshold: float) -> DataFrame:
    """(row, key, id: the smallest doc_id, docs: how many rows, n, parity, fine, prefix, sketches) of every set of chains in ``prints`` (doc_id, key, spots) but the empty one, written down.

    A key is 128 bits of a digest of the set. The id of rows that all have no doc_id is null. A
    prefix is the rarest chains, as many as a similar set can't all miss; sets themselves are
    left in ``prints``.
    """
    levels = chain_levels(prints)
    n = F.size("spots")
    level = lambda s: F.get(F.col("cells"), _bucket(s).cast("int"))
    ordered = F.array_sort(F.transform("spots", lambda s: F.struct(level(s).alias("level"), s.alias("spot"))))
    length = n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1
    prefix = F.transform(F.slice(ordered, F.lit(1), length), lambda c: c["spot"])
    own = prints.filter(F.size("spots") > 0).withColumn("cells", levels.scalar())
    own = own.select("key", "doc_id", F.struct(n.alias("n"), _parity(F.col("spots")).alias("parity"), _fine(F.col("spots")).alias("fine"), prefix.alias("prefix"), sketches(F.col("spots")).alias("sketches")).alias("own"))
    held = own.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("docs"), F.first("own").alias("own"))
    return materialize(held.select(F.monotonically_increasing_id().alias("row"), "key", "id", "docs", "own.*"), "spot-classes")


def near_centres(prints: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(row, centre, c, w, edits, fine) of classes near the centre of their group, written down.

    A class joins the most frequent of its sketches; a group's centre is the set of ``c`` chains
    that more than half of it hold. Centres that share a sketch leave their groups to the largest
    of them. ``edits`` are the chains in which a class differs from its centre, and ``w`` is
    q * those it lacks + p * those it has besides, where ``threshold`` is p / q.

    Two classes of one centre that differ from it in o chains alike are at ``threshold`` exactly if
    (p + q) * o >= the sum of their w - (q - p) * c, for they share c - those that either lacks + o.
    A threshold that is no fraction of small numbers has no centres.
    """
    p, q = _fraction(threshold)
    if not q:
        return classes.sparkSession.createDataFrame([], "row long, centre long, c int, w int, edits array<bigint>, fine array<bigint>")
    sketched = classes.select("row", F.posexplode("sketches").alias("k", "sketch"))
    large = sketched.groupBy("k", "sketch").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") >= GROUP)
    best = sketched.join(large, ["k", "sketch"]).groupBy("row").agg(F.max(F.struct("classes", "k", "sketch")).alias("best"))
    chosen = best.select("row", F.xxhash64("best.k", "best.sketch").alias("chosen"))
    members = materialize(chosen.join(classes.select("row", "key", "fine"), "row"), "centre-members")
    sets = prints.join(small_side(members.select("key")), "key", "left_semi").groupBy("key").agg(F.first("spots").alias("spots"))
    held = materialize(members.join(sets, "key").select("row", "chosen", "fine", "spots"), "centre-sets")
    sizes = members.groupBy("chosen").agg(F.count(F.lit(1)).alias("members"))
    counted = held.select("chosen", F.explode("spots").alias("spot")).groupBy("chosen", "spot").agg(F.count(F.lit(1)).alias("holders"))
    core = counted.join(small_side(sizes), "chosen").filter(2 * F.col("holders") > F.col("members"))
    # A centre holds less than twice as many chains as its group's average set.
    cores = materialize(core.groupBy("chosen", "members").agg(F.collect_list("spot").alias("core")), "centre-cores")
    shown = cores.select("chosen", "members", F.posexplode(sketches(F.col("core"))).alias("k", "sketch"))
    first = shown.groupBy("k", "sketch").agg(F.max(F.struct("members", "chosen")).alias("first"))
    taken = shown.select("chosen", "k", "sketch").join(first, ["k", "sketch"]).groupBy("chosen").agg(F.max("first")["chosen"].alias("centre"))
    centres = taken.join(cores.select(F.col("chosen").alias("centre"), "core"), "centre")
    centres = materialize(centres, "centres")
    chains_of_centres = centres.agg(F.sum(F.size("core"))).first()[0] or 0
    c, lacks, besides = F.size("core"), F.array_except("core", "spots"), F.array_except("spots", "core")
    near = held.join(small_side(centres, chains_of_centres), "chosen")
    near = near.select("row", "centre", c.alias("c"), (q * F.size(lacks) + p * F.size(besides)).alias("w"), F.concat(lacks, besides).alias("edits"), "fine")
    near = materialize(near.filter(F.col("w") <= FAR * (q - p) * F.col("c")), "near-centres")
    for done in (members, held, cores, centres):
        drop(done)
    return near


def _fraction(threshold: float) -> tuple[int, int]:
    """p and q of a threshold p / q, or zeros if it is none of small numbers."""
    found = Fraction(threshold).limit_denominator(1000)
    return (found.numerator, found.denominator) if found > 0 and float(found) == threshold else (0, 0)


def centre_links(near: DataFrame, threshold: float) -> DataFrame:
    """(row, n_links): with how many others of its centre each class of ``near_centres`` is linked.

    Those so near that they are linked whatever edits they share are counted by w. Others are
    linked only if they share edits, on which they meet.
    """
    p, q = _fraction(threshold)
    room = (q - p) * F.col("c")
    # At most (q - p) * c + 1 cells a centre.
    cells = near.filter(F.col("w") <= room).groupBy("centre", "c", "w").agg(F.count(F.lit(1)).alias("classes"))
    cells = materialize(cells, "centre-cells")
    none = F.lit(None).cast("int")
    marks = cells.select("centre", F.col("w").alias("at"), "classes", none.alias("w"))
    marks = marks.unionByName(cells.select("centre", (room - F.col("w")).alias("at"), F.lit(0).cast("long").alias("classes"), "w"))
    met = marks.withColumn("n", F.sum("classes").over(Window.partitionBy("centre").orderBy("at"))).filter(F.col("w").isNotNull()).select("centre", "w", "n")
    own = F.when(2 * F.col("w") <= room, 1).otherwise(0)
    sure = near.select("row", "centre", "c", "w").join(small_side(met), ["centre", "w"]).select("row", (F.col("n") - own).alias("n_links"))
    pairs = materialize(edit_pairs(near, threshold), "edit-pairs")
    return sure.unionByName(pairs.select(F.explode(F.array("a", "b")).alias("row"), F.lit(1).cast("long").alias("n_links")))


def edit_pairs(near: DataFrame, threshold: float) -> DataFrame:
    """(a, b): linked classes of one centre that must share edits to be so."""
    p, q = _fraction(threshold)
    listed = near.select("row", "centre", "c", "w", F.size("edits").alias("n"), "fine", F.explode("edits").alias("spot"))
    shared = listed.groupBy("centre", "spot").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    listed = materialize(listed.join(shared.select("centre", "spot"), ["centre", "spot"]), "centre-edits")  # written, so that the join can be split
    side = lambda s: listed.select("centre", "spot", *[F.col(x).alias(f"{s}_{x}") for x in ("row", "c", "w", "n", "fine")])
    over = F.col("a_w") + F.col("b_w") - (q - p) * F.col("a_c")
    least = F.ceil(over / (p + q) - 1e-9)
    met = side("a").join(side("b").drop("b_c"), ["centre", "spot"])
    met = met.filter((F.col("a_row") < F.col("b_row")) & (over > 0) & (_apart() <= F.col("a_n") + F.col("b_n") - 2 * least))
    alike = met.groupBy("a_row", "b_row", over.alias("over")).agg(F.count(F.lit(1)).alias("alike"))
    return alike.filter((p + q) * F.col("alike") >= F.col("over")).select(F.col("a_row").alias("a"), F.col("b_row").alias("b"))


def _apart() -> Column:
    """In how many of their 256 bits of parity sets differ, which are as many chains at least."""
    return sum((F.bit_count(F.get("a_fine", F.lit(k)).bitwiseXOR(F.get("b_fine", F.lit(k)))) for k in range(4)), F.lit(0))


def candidate_pairs(classes: DataFrame, threshold: float, near: DataFrame | None = None) -> DataFrame:
    """(a, b): rows of classes that share a prefix chain where sizes, places and parities allow ``threshold``.

    Sets are partitioned by length so that only neighbouring partitions can hold a similar pair.
    The larger of a pair, or of equal ones the one of larger row, is looked for in its own
    partition and in the one below; the smaller one needs a shorter prefix. Pairs of one centre
    of ``near`` are left out.
    """
    part = F.floor(F.log(F.col("n")) / -F.log(F.lit(threshold)))
    fields = ["row", "n", "parity", "place", "centre"]
    told = classes.withColumn("centre", F.lit(None).cast("long")) if near is None else classes.join(small_side(near.select("row", "centre")), "row", "left")
    listed = lambda prefix: told.select("row", "n", "parity", "centre", part.alias("part"), F.posexplode(prefix).alias("place", "spot"))
    own = F.ceil(F.lit(threshold / (1 + threshold)) * 2 * F.col("n") - 1e-9)
    short = F.slice("prefix", F.lit(1), (F.col("n") - own + 1).cast("int"))
    left = listed(short).select("spot", "part", *[F.col(c).alias(f"a_{c}") for c in fields])
    right = listed(F.col("prefix")).select("spot", F.explode(F.array("part", F.col("part") - 1)).alias("part"), *[F.col(c).alias(f"b_{c}") for c in fields])
    ordered = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_row") < F.col("b_row")))
    least = _shared(threshold)
    differ = F.bit_count(F.col("a_parity").bitwiseXOR(F.col("b_parity")))
    early = (F.col("a_place") <= F.col("a_n") - least) & (F.col("b_place") <= F.col("b_n") - least)  # where the first shared chain can be
    possible = (F.col("a_n") >= F.lit(threshold) * F.col("b_n") - 1e-9) & (differ <= F.col("a_n") + F.col("b_n") - 2 * least) & early
    counted = F.coalesce(F.col("a_centre") == F.col("b_centre"), F.lit(False))
    met = left.join(right, ["spot", "part"]).filter(ordered & possible & ~counted)
    met = met.select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b")).distinct()
    side = lambda p: classes.select(F.col("row").alias(p), F.col("n").alias(f"{p}_n"), F.col("fine").alias(f"{p}_fine"))
    known = materialize(met, "spot-met").join(side("a"), "a").join(side("b"), "b")
    return known.filter(_apart() <= F.col("a_n") + F.col("b_n") - 2 * _shared(threshold)).select("a", "b")


def class_pairs(prints: DataFrame, classes: DataFrame, threshold: float = 0.8, near: DataFrame | None = None) -> DataFrame:
    """(a, b, a_id, b_id, likeness) of ``fingerprint_classes`` at ``threshold`` or above, a and b their rows; without those of one centre of ``near``."""
    pairs = materialize(candidate_pairs(classes, threshold, near), "spot-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct().join(classes.select("row", "key", "id"), "row")
    asked = materialize(asked, "spot-asked")
    sets = prints.join(small_side(asked.select("key")), "key", "left_semi").groupBy("key").agg(F.first("spots").alias("spots"))
    sets = materialize(asked.join(sets, "key").select("row", "id", "spots"), "spot-sets")
    side = lambda p: sets.select(F.col("row").alias(p), F.col("id").alias(f"{p}_id"), F.col("spots").alias(f"{p}_spots"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "a_id", "b_id", likeness(F.col("a_spots"), F.col("b_spots"), threshold).alias("likeness")).filter(F.col("likeness") >= threshold)


def class_links(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(key, class_id, n_links, docs) of every class of ``prints``: how many others are at ``threshold`` or above, and its rows; written down.

    Links of one centre are told by edits to it; only the others are listed and verified.
    """
    classes = fingerprint_classes(prints, threshold)
    near = near_centres(prints, classes, threshold)
    listed = class_pairs(prints, classes, threshold, near).select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n_links"))
    ends = listed.unionByName(centre_links(near, threshold)).groupBy("row").agg(F.sum("n_links").alias("n_links"))
    counted = classes.select("row", "key", F.col("id").alias("class_id"), "docs").join(ends, "row", "left")
    links = materialize(counted.select("key", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "docs"), "spot-links")
    drop(classes)
    return links


def near_pairs(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints at ``threshold`` or above, each by its smallest doc_id.

    Documents of one fingerprint are one class. Null and empty texts are linked with nothing, and
    classes of rows without doc_id are left out, as they have no name here; an empty table gives
    no pairs; other columns are ignored. Rows of one doc_id with several texts are in several classes.
    """
    spots = docs.select("doc_id", chains(F.coalesce("text", F.lit("")), chain).alias("spots")).withColumn("key", class_key(F.col("spots")))
    spots = materialize(spots, "fingerprints")
    named = class_pairs(spots, fingerprint_classes(spots, threshold), threshold).filter("a_id is not null and b_id is not null")
    return named.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "likeness")

"""Faces, display groups and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.scratch import written


def group_key(face: str = "") -> Column:
    """A durable person (negative) or, without one, an appearance cluster (positive)."""
    return F.coalesce(-F.col(f"{face}identity_id"), F.col(f"{face}cluster_id"))


def pool(faces: DataFrame) -> DataFrame:
    return faces.filter(F.col("cluster_id").isNotNull() & (F.col("ignored") == 0)).withColumn("g", group_key())


def overview(faces: DataFrame, identities: DataFrame) -> DataFrame:
    """Every group's size, its best-scored face (the smaller id on a tie) and its name."""
    best = F.max(F.struct("score", (-F.col("id")).alias("i")))["i"]
    groups = pool(faces).groupBy("g").agg(F.count(F.lit(1)).alias("count"), (-best).alias("cover_face_id"))
    named = identities.select((-F.col("id")).alias("g"), "name")
    return groups.join(named, "g", "left").select("g", "count", "cover_face_id", "name")


def ranked_overview(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.col("name").isNull(), F.desc("count"), "g")


def listed(groups: DataFrame, settled: bool) -> DataFrame:
    """Groups worth a tile, and the tail of unnamed ones below the floor."""
    floor = 2 if settled else 8
    return groups.withColumn("shelf", F.when(F.col("name").isNotNull() | (F.col("count") >= floor), "tile").when(F.col("count") < 2, "tail").otherwise("later"))


def new_person(groups: DataFrame, seen: DataFrame, floor: int = 8) -> DataFrame:
    """The largest unnamed group of ``floor`` faces or more that was not announced yet."""
    fresh = groups.filter(F.col("name").isNull() & (F.col("count") >= floor)).join(seen, "g", "left_anti")
    return fresh.orderBy(F.desc("count"), "g").limit(1)


def top_faces(faces: DataFrame, n: int) -> DataFrame:
    """The best ``n`` faces of every group."""
    order = Window.partitionBy("g").orderBy(F.desc("score"), "id")
    return pool(faces).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("g", "rank", "id", "score")


def group_faces(faces: DataFrame, group: int) -> DataFrame:
    return pool(faces).filter(F.col("g") == group).select("id", "score").orderBy(F.desc("score"), "id")


def faces_in_photo(faces: DataFrame, identities: DataFrame, photo: int) -> DataFrame:
    rows = faces.filter((F.col("photo_id") == photo) & (F.col("ignored") == 0)).withColumn("g", group_key())
    named = identities.select(F.col("id").alias("identity_id"), "name")
    return rows.join(named, "identity_id", "left").select("id", "g", "name", "score", "x1", "y1", "x2", "y2").orderBy(F.desc("score"), "id")


def group_in_photos(faces: DataFrame, group: int, photo_ids: DataFrame) -> DataFrame:
    return pool(faces).filter(F.col("g") == group).join(photo_ids, "photo_id", "left_semi").select("id")


def person_photos(photos: DataFrame, faces: DataFrame, group: int) -> DataFrame:
    mine = pool(faces).filter(F.col("g") == group).select(F.col("photo_id").alias("id"))
    rows = photos.join(mine, "id", "left_semi")
    return rows.select("id", "thumb_status", S.sort_ts().alias("ts"), (F.col("favorite") != 0).alias("favorite")).orderBy(F.desc("ts"), F.desc("id"))


def person_faces(photos: DataFrame, faces: DataFrame, group: int) -> DataFrame:
    mine = pool(faces).filter(F.col("g") == group)
    dated = photos.select(F.col("id").alias("photo_id"), S.sort_ts().alias("ts"))
    return mine.join(dated, "photo_id").select("id", "photo_id", "ts", "score").orderBy("ts", "id")


def cooccurring_pairs(faces: DataFrame, a: int, b: int) -> DataFrame:
    left = pool(faces).filter(F.col("g") == a).select("photo_id", F.col("id").alias("a"))
    right = pool(faces).filter(F.col("g") == b).select("photo_id", F.col("id").alias("b"))
    return left.join(right, "photo_id").select("photo_id", "a", "b")


def multi_face_boxes(faces: DataFrame) -> DataFrame:
    shared = F.count(F.lit(1)).over(Window.partitionBy("photo_id")) > 1
    return pool(faces).withColumn("_shared", shared).filter("_shared").select("photo_id", "id", "x1", "y1", "x2", "y2")


def double_detections(faces: DataFrame, iou: float = 0.4) -> DataFrame:
    """Pairs of boxes in one photo that overlap so much that they are one face."""
    a = multi_face_boxes(faces)
    b = a.select("photo_id", *[F.col(c).alias(f"b_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    box = lambda p: tuple(F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2"))
    pairs = a.join(b, "photo_id").filter(F.col("id") < F.col("b_id")).withColumn("iou", S.box_iou(box(""), box("b_")))
    return pairs.filter(F.col("iou") >= iou).select(F.col("id").alias("a"), F.col("b_id").alias("b"), "iou")


def symmetric(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Unordered pairs, the smaller id first, each once."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


#: People of a block; a task meets the people of two blocks at a time.
PEOPLE_BLOCK = 2048


def _met(rows: DataFrame, unlike: str, block: int) -> DataFrame:
    """(a, b) of all rows with ids a < b that ``unlike`` (over columns, and b_ of them) is true of.

    Blocks are ranges of ids, so that a pair of blocks is met once, in one task, and no pair of rows is
    shuffled. Pairs are quadratic in the rows; what a task holds is not.
    """
    n = -(-rows.count() // block) or 1
    held = written(rows.repartitionByRange(n, "id").withColumn("_block", F.spark_partition_id()), "people-blocks")
    n = (held.agg(F.max("_block")).first()[0] or 0) + 1
    tasks = min(n * (n + 1) // 2, 64 * rows.sparkSession.sparkContext.defaultParallelism)
    unit = lambda i, j: (i * n + j).cast("long").alias("_unit")
    a = held.withColumn("_other", F.explode(F.sequence(F.col("_block"), F.lit(n - 1)))).select(*rows.columns, unit(F.col("_block").cast("long"), F.col("_other")))
    b = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_block")))).select(*[F.col(c).alias(f"b_{c}") for c in rows.columns], unit(F.col("_other").cast("long"), F.col("_block")))
    return a.repartition(tasks, "_unit").join(b.repartition(tasks, "_unit"), "_unit").filter(F.expr(f"id < b_id AND ({unlike})")).select(F.col("id").alias("a"), F.col("b_id").alias("b"))


def implicit_cannot_links(identities: DataFrame, block: int = PEOPLE_BLOCK) -> DataFrame:
    """People of different names are different people."""
    return _met(identities.filter("name is not null").select("id", "name"), "name <> b_name", block)


def constraint_union(explicit: DataFrame, implicit: DataFrame) -> DataFrame:
    return symmetric(explicit).union(symmetric(implicit)).distinct()


def cannot_links(explicit: DataFrame, identities: DataFrame, block: int = PEOPLE_BLOCK) -> DataFrame:
    """Pairs that someone told apart and pairs of different names, each once.

    An id's least and greatest name say whether two ids have names that differ, so pairs of names are
    made once each, and an explicit pair needs only its own two ids to tell that it is among them.
    """
    names = written(identities.filter("name is not null").groupBy("id").agg(F.min("name").alias("lo"), F.max("name").alias("hi")), "people-names")
    side = lambda p: names.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("lo", "hi")])
    named = F.coalesce(F.expr("a < b AND (a_lo <> b_hi OR a_hi <> b_lo)"), F.lit(False))
    told = symmetric(explicit).join(side("a"), "a", "left").join(side("b"), "b", "left").filter(~named).select("a", "b")
    return _met(names, "lo <> b_hi OR hi <> b_lo", block).union(told)


def cooccurrence(faces: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(g, identity_id): groups, all or some (g), photographed together with a confirmed face of a person."""
    groups = pool(faces).select("g", "photo_id").distinct()
    groups = groups if only is None else groups.join(only, "g", "left_semi")
    confirmed = faces.filter("confirmed = 1 and ignored = 0 and identity_id is not null").select("identity_id", "photo_id").distinct()
    return groups.join(confirmed, "photo_id").filter(F.col("g") != -F.col("identity_id")).select("g", "identity_id").distinct()


def confirmed_counts(faces: DataFrame, at_least: int = 1) -> DataFrame:
    rows = faces.filter("confirmed = 1 and identity_id is not null and ignored = 0")
    return rows.groupBy("identity_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)


def group_for_name(faces: DataFrame, identities: DataFrame, name: str) -> DataFrame:
    held = faces.filter("ignored = 0").select(F.col("identity_id").alias("id"))
    found = identities.filter(F.lower("name") == F.lower(F.lit(name.strip()))).join(held, "id", "left_semi")
    return found.select((-F.col("id")).alias("g")).orderBy(F.desc("g")).limit(1)


def other_named_person(faces: DataFrame, identities: DataFrame, own: int | None) -> DataFrame:
    """Groups that are people with a name and confirmed faces, other than ``own``."""
    named = identities.filter("name is not null").select(F.col("id").alias("identity_id"))
    rows = faces.filter("confirmed = 1").join(named, "identity_id").filter(F.col("identity_id") != (own if own is not None else 0))
    return rows.groupBy((-F.col("identity_id")).alias("g")).agg(F.count(F.lit(1)).alias("faces"))


def suggestions(identities: DataFrame, text: str, exclude: int | None = None, limit: int = 6) -> DataFrame:
    rows = identities.filter(F.contains(S.fold(F.col("name")), F.lit(S.fold_literal(text))))
    return (rows.filter(F.col("id") != exclude) if exclude is not None else rows).select("id", "name").orderBy("name", "id").limit(limit)


def exact_name(identities: DataFrame, text: str, exclude: int | None = None) -> DataFrame:
    rows = identities.filter(S.fold(F.col("name")) == S.fold_literal(text.strip()))
    return (rows.filter(F.col("id") != exclude) if exclude is not None else rows).select("id", "name")


def face_box(faces: DataFrame, face: int) -> DataFrame:
    """The photo that a face is in, and where."""
    return faces.filter(F.col("id") == face).select("photo_id", "x1", "y1", "x2", "y2")


def must_links(faces: DataFrame) -> DataFrame:
    """(id, identity_id) of faces that the user confirmed, which a clustering keeps together."""
    return faces.filter(F.col("identity_id").isNotNull() & (F.col("confirmed") == 1)).select("id", "identity_id")


def confirmed_photos(faces: DataFrame) -> DataFrame:
    return faces.filter(F.col("identity_id").isNotNull() & (F.col("confirmed") == 1)).select("identity_id", "photo_id")


def group_photos(faces: DataFrame) -> DataFrame:
    return pool(faces).select("g", "photo_id")


def embeddings(faces: DataFrame, layer: str = "groups") -> DataFrame:
    """Vectors of the faces in play: with display groups, with clusters and photos, or with ids only."""
    return pool(faces).select(*{"groups": ("id", "g"), "clusters": ("cluster_id", "photo_id"), "all": ("id",)}[layer], "embedding")

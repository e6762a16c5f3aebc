"""Registered queries of what people decide and what the engine keeps, and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.operators import clusters, library, mutations, people, recognition, suggestions
from heliograph.plans.catalogue import CLAIMS, LOOSE, ORACLES, oracle_sql, queries, query  # its registry holds these too
from heliograph.scratch import folder
from heliograph.sources import fixtures as X

IN_PLAY = "cluster_id IS NOT NULL AND ignored = 0"
FIELDS = ("id", "identity_id", "confirmed", "ignored", "cluster_id")


def _catalog(spark, d) -> mutations.Catalog:
    pairs = X.cannot_link(spark)
    return mutations.Catalog(X.photos(spark, d), X.faces(spark, d), X.identities(spark), pairs, pairs.limit(0))


def _faces(c: mutations.Catalog):
    return c.faces.select(*FIELDS)


# ---- lookups and lists ----


@query("SELECT photo_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM faces WHERE id = 41")
def photo_of_face(spark, d):
    return people.face_box(X.faces(spark, d), 41).select("photo_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("SELECT id, identity_id FROM faces WHERE identity_id IS NOT NULL AND confirmed = 1")
def must_links(spark, d):
    return people.must_links(X.faces(spark, d))


@query("SELECT identity_id, photo_id FROM faces WHERE identity_id IS NOT NULL AND confirmed = 1")
def confirmed_photos(spark, d):
    return people.confirmed_photos(X.faces(spark, d))


@query("SELECT g, photo_id FROM pool")
def group_photos(spark, d):
    return people.group_photos(X.faces(spark, d))


@query("SELECT id, g, CAST(len(embedding) AS INTEGER) AS size, round(embedding[1]::DOUBLE, 6) AS x FROM pool")
def group_embeddings(spark, d):
    return people.embeddings(X.faces(spark, d)).select("id", "g", F.size("embedding").alias("size"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x"))


@query("SELECT cluster_id, photo_id, round(embedding[64]::DOUBLE, 6) AS x FROM faces WHERE " + IN_PLAY)
def cluster_embeddings(spark, d):
    return people.embeddings(X.faces(spark, d), "clusters").select("cluster_id", "photo_id", F.round(F.get("embedding", F.lit(63)).cast("double"), 6).alias("x"))


ROWS = "SELECT DISTINCT p.id, coalesce(p.taken_ts, p.mtime) AS ts FROM photos p JOIN pool f ON f.photo_id = p.id AND f.g = -1"


def _person(spark, d):
    photos = X.photos(spark, d).select("id", S.sort_ts().alias("ts"))
    return photos.join(people.pool(X.faces(spark, d)).filter("g = -1").select(F.col("photo_id").alias("id")), "id", "left_semi")


@query(f"SELECT * FROM ({ROWS}) WHERE id % 2 = 1")
def rows_of_a_look(spark, d):
    rows = _person(spark, d)
    looks = rows.groupBy((F.col("id") % 2).cast("int").alias("look")).agg(F.collect_list("id").alias("photo_ids"))
    return library.in_look(rows, looks, 1)


@query(ROWS)
def rows_put_back(spark, d):
    rows = _person(spark, d)
    return library.insert_sorted(rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0"))


# ---- queues ----


@query("SELECT id, path, CASE WHEN id IN (SELECT id FROM photos WHERE thumb_status = 1 AND (id % 3) = 0 ORDER BY id LIMIT 40) THEN 2 WHEN id % 3 = 0 THEN 0 ELSE 1 END AS faces_scanned FROM photos")
def claimed_faces(spark, d):
    photos = X.photos(spark, d).withColumn("faces_scanned", F.when(F.col("id") % 3 == 0, 0).otherwise(1))
    return mutations.claim_faces(photos, 40)[0].select("id", "path", "faces_scanned")


@query("SELECT id, path FROM photos WHERE thumb_status = 1 AND (id % 3) = 0 ORDER BY id LIMIT 40")
def claimed_jobs(spark, d):
    photos = X.photos(spark, d).withColumn("faces_scanned", F.when(F.col("id") % 3 == 0, 0).otherwise(1))
    return mutations.claim_faces(photos, 40)[1].select("id", "path")


@query("SELECT id, CASE WHEN id % 3 = 2 THEN 0 ELSE CAST(id % 3 AS INTEGER) END AS faces_scanned FROM photos")
def released_claims(spark, d):
    photos = X.photos(spark, d).withColumn("faces_scanned", (F.col("id") % 3).cast("int"))
    return mutations.release_claims(photos).select("id", "faces_scanned")


@query("""WITH groups AS (SELECT p.g, count(*) AS n FROM pool p GROUP BY 1), names AS (SELECT -id AS g, name FROM identities)
SELECT count(*) AS cards, CAST(sum(n) AS BIGINT) AS photos, count(name) AS named FROM groups LEFT JOIN names USING (g)""")
def queue_summary(spark, d):
    groups = people.overview(X.faces(spark, d), X.identities(spark))
    return recognition.queue_summary(groups.withColumnRenamed("count", "photos"), groups)


@query("SELECT identity_id, count(*) AS groups, CAST(sum(photos) AS BIGINT) AS photos FROM (SELECT coalesce(identity_id, 0) AS identity_id, id AS photos, CASE WHEN id % 2 = 0 THEN 'maybe' ELSE 'strong' END AS tier FROM faces) WHERE tier = 'maybe' GROUP BY 1")
def reviewable_people(spark, d):
    cards = X.faces(spark, d).select(F.coalesce("identity_id", F.lit(0).cast("long")).alias("identity_id"), F.col("id").alias("photos"), F.when(F.col("id") % 2 == 0, "maybe").otherwise("strong").alias("tier"))
    return recognition.reviewable(cards)


@query("SELECT 'ready' AS library, count(*) AS prompts FROM pool UNION ALL SELECT 'unsettled', 0")
def settled_prompts(spark, d):
    photos, prompts = X.photos(spark, d), people.pool(X.faces(spark, d))
    unsettled = photos.withColumn("faces_scanned", F.lit(0))
    count = lambda df, label: df.agg(F.count(F.lit(1)).alias("prompts")).select(F.lit(label).alias("library"), "prompts")
    return count(recognition.settled(photos, prompts), "ready").unionByName(count(recognition.settled(unsettled, prompts), "unsettled"))


# ---- tables ----


@query("SELECT key, coalesce(new, old) AS value FROM (SELECT CAST(id AS VARCHAR) AS key, CASE WHEN id % 2 = 0 THEN 'b' || id END AS new, CASE WHEN id % 3 = 0 THEN 'a' || id END AS old FROM photos) WHERE coalesce(new, old) IS NOT NULL")
def meta_upsert(spark, d):
    rows = lambda n, letter: X.photos(spark, d).filter(F.col("id") % n == 0).select(F.col("id").cast("string").alias("key"), F.concat(F.lit(letter), F.col("id").cast("string")).alias("value"))
    return mutations.latest_by_key(rows(3, "a"), rows(2, "b"))


@query("SELECT id, coalesce(taken_ts, 1718366400 + (id % 20) * 86400) AS taken_ts FROM photos")
def dates_filled(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-06-14").cast("date"), (F.col("id") % 20).cast("int")), "yyyyMMdd")
    photos = X.photos(spark, d).withColumn("path", F.concat(F.lit("/lib/IMG_"), day, F.lit("_120000.jpg")))
    return mutations.fill_dates(photos).select("id", "taken_ts")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 12.5 ELSE lat END AS lat, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS geo_scanned FROM photos")
def positions_set(spark, d):
    photos = X.photos(spark, d).withColumn("geo_scanned", F.lit(0))
    found = photos.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, 12.5).alias("lat"), F.when(F.col("id") % 4 == 0, -3.5).alias("lon"))
    return mutations.set_positions(photos, found).select("id", "lat", "geo_scanned")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN id * 10 ELSE cluster_id END AS cluster_id FROM faces")
def clusters_applied(spark, d):
    faces = X.faces(spark, d)
    return mutations.apply_clusters(faces, faces.filter("id % 2 = 0").select("id", (F.col("id") * 10).alias("cluster"))).select("id", "cluster_id")


@query("SELECT count(*) AS photos, 0 AS scanned, 0 AS faces, 0 AS identities FROM photos")
def faces_reset(spark, d):
    c = _catalog(spark, d)
    after = mutations.reset_all_faces(c.photos, c)
    photos = after.photos.agg(F.count(F.lit(1)).alias("photos"), F.count_if(F.col("faces_scanned") != 0).cast("int").alias("scanned"))
    none = lambda df: df.agg(F.count(F.lit(1)).cast("int")).scalar()
    return photos.withColumns({"faces": none(after.faces), "identities": none(after.identities)})


# ---- decisions ----

CHOSEN = "id % 37 = 0"
NEW = "(SELECT max(id) + 1 FROM identities)"


def _ids(faces, condition: str):
    return faces.filter(condition).select("id")  # what a user tags


@query(f"SELECT id, CASE WHEN {CHOSEN} THEN 2 ELSE identity_id END AS identity_id, CASE WHEN {CHOSEN} THEN 1 ELSE confirmed END AS confirmed, ignored, cluster_id FROM faces")
def faces_named(spark, d):
    c = _catalog(spark, d)
    return _faces(mutations.name_faces(c, _ids(c.faces, CHOSEN), " Ángel ")[0])


@query(f"SELECT id, CASE WHEN {CHOSEN} THEN {NEW} ELSE identity_id END AS identity_id, CASE WHEN {CHOSEN} THEN 1 ELSE confirmed END AS confirmed, ignored, cluster_id FROM faces")
def faces_named_anew(spark, d):
    c = _catalog(spark, d)
    return _faces(mutations.name_faces(c, _ids(c.faces, CHOSEN), "Somebody new")[0])


@query("""SELECT id, CASE WHEN id % 30 = 0 THEN 1 WHEN id % 30 = 10 THEN 2 WHEN id % 30 <> 20 THEN identity_id END AS identity_id,
 CASE WHEN id % 30 IN (0, 10) THEN 1 WHEN id % 30 = 20 THEN 0 ELSE confirmed END AS confirmed, ignored, cluster_id FROM faces""")
def group_split(spark, d):
    c = _catalog(spark, d)
    return _faces(mutations.split(c, {-1: _ids(c.faces, "id % 30 = 0"), -2: _ids(c.faces, "id % 30 = 10")}, _ids(c.faces, "id % 30 = 20"))[0])


@query(f"SELECT {', '.join(FIELDS)} FROM faces")
def group_split_undone(spark, d):
    c = _catalog(spark, d)
    after, prior = mutations.split(c, {-1: _ids(c.faces, "id % 30 = 0")}, _ids(c.faces, "id % 30 = 20"))
    return _faces(mutations.undo(after, prior))


OWN = "coalesce(-identity_id, cluster_id) = 7 AND identity_id IS NULL AND ignored = 0"


@query(f"SELECT id, CASE WHEN {OWN} THEN {NEW} ELSE identity_id END AS identity_id, CASE WHEN {OWN} OR (identity_id = 1 AND ignored = 0) THEN 1 ELSE confirmed END AS confirmed, ignored, cluster_id FROM faces")
def merge_rejected(spark, d):
    return _faces(mutations.reject_merge(_catalog(spark, d), -1, 7))


@query(f"SELECT a, b FROM cannot_link UNION SELECT 1, {NEW}")
def merge_rejected_links(spark, d):
    return mutations.reject_merge(_catalog(spark, d), -1, 7).cannot_link


@query(f"SELECT a, b FROM cannot_link UNION SELECT 1, {NEW} UNION SELECT 3, {NEW}")
def not_these_people(spark, d):
    return mutations.not_this_person(_catalog(spark, d), 7, [-1, -3]).cannot_link


@query(f"SELECT id, name FROM identities UNION ALL SELECT {NEW}, 'Ada'")
def group_named(spark, d):
    return mutations.name_group(X.faces(spark, d), X.identities(spark), 7, " Ada ")[1]


@query("SELECT id, CASE WHEN id % 41 = 0 THEN 3 ELSE identity_id END AS identity_id, CASE WHEN id % 41 = 0 THEN 1 ELSE confirmed END AS confirmed, CASE WHEN id % 41 = 0 THEN 0 ELSE ignored END AS ignored, cluster_id FROM faces")
def faces_reassigned(spark, d):
    c = _catalog(spark, d)
    return _faces(mutations.reassign(c, _ids(c.faces, "id % 41 = 0"), -1, -3))


# ---- recognition ----


@query()
def anchor_scores_trimmed(spark, d):
    """With the anchor-core step; held against plain Python in the tests."""
    return recognition.matches(X.faces(spark, d), LOOSE).select("identity_id", "g", "size", "matched", F.round("max_sim", 6).alias("max_sim"))


@query("WITH " + CLAIMS + " SELECT identity_id, name, g, photos, round(sim, 6) AS sim, claimants FROM claims")
def kept_claims(spark, d):
    """Suggestions kept from before some faces were named and others set aside, and brought up to date."""
    before, who = X.faces(spark, d), X.identities(spark)
    kept = suggestions.full(before, who, f"{folder(spark)}/heliograph/suggestions-{uuid.uuid4().hex}", 1, LOOSE, trim=False)
    after = mutations.ignore(mutations.set_person(before, _ids(before, DECIDED), 2), _ids(before, LEFT))
    kept = suggestions.refresh(kept, before, after, who, LOOSE, trim=False)
    return suggestions.serve(kept, X.photos(spark, d).withColumn("faces_scanned", F.lit(1)), 2).withColumn("sim", F.round("sim", 6))


DECIDED, LEFT = "cluster_id % 25 = 1 AND id % 10 < 6", "id % 401 = 7"
ORACLES["kept_claims"] = ORACLES["kept_claims"].replace(X.FACES, f"""SELECT * REPLACE (CASE WHEN {DECIDED} THEN 2 ELSE identity_id END AS identity_id, CASE WHEN {DECIDED} THEN 1 ELSE confirmed END AS confirmed,
 CASE WHEN {LEFT} THEN 1 ELSE ignored END AS ignored) FROM ({X.FACES})""")


@query("SELECT CAST(0 AS BIGINT) AS violations")
def suppression_violations(spark, d):
    """Boxes that stay and overlap a better one that stays, and boxes that went without one."""
    faces, kept = X.faces(spark, d), clusters.suppressed(X.faces(spark, d), 0.1).withColumn("stays", F.lit(1))
    box = ("x1", "y1", "x2", "y2")
    all_ = faces.join(kept, ["photo_id", "id"], "left").select("photo_id", "id", "score", *box, F.coalesce("stays", F.lit(0)).alias("stays"))
    other = all_.filter("stays = 1").select("photo_id", *[F.col(c).alias(f"o_{c}") for c in ("id", "score", *box)])
    met = all_.join(other, "photo_id").filter("id <> o_id and (o_score > score or (o_score = score and o_id < id))")
    near = S.box_iou([F.col(c) for c in box], [F.col(f"o_{c}") for c in box]) >= 0.1
    beaten = met.filter(near).select("id").distinct().withColumn("beaten", F.lit(1))
    return all_.join(beaten, "id", "left").agg(F.count_if(F.col("stays") + F.coalesce("beaten", F.lit(0)) != 1).alias("violations"))

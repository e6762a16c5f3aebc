"""Changes as functions from tables to tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.operators.people import group_key, symmetric
from heliograph.plans.params import CLAIMED, CLOUD, DOWNLOADING, PENDING, READY, UNSCANNED


class StaleVersion(Exception):
    """Somebody committed since the caller looked."""


@dataclass(frozen=True)
class Catalog:
    """The library's tables at one version; a commit gives the next, if nobody was faster."""

    photos: DataFrame
    faces: DataFrame
    identities: DataFrame
    cannot_link: DataFrame
    same_photo_ok: DataFrame
    version: int = 0

    def check(self, expected: int | None) -> None:
        """Refuse what was decided on another version; None stands for a caller that showed nothing."""
        if expected not in (None, self.version):
            raise StaleVersion(f"version {self.version}, expected {expected}")

    def commit(self, expected: int | None, **tables: DataFrame) -> Catalog:
        self.check(expected)
        return replace(self, version=self.version + 1, **tables)

    def checkpointed(self) -> Catalog:
        """The same with lineage cut, written to the shared checkpoint folder."""
        names = ("photos", "faces", "identities", "cannot_link", "same_photo_ok")
        return replace(self, **{n: getattr(self, n).checkpoint() for n in names})


def _set(df: DataFrame, when: Column, **values) -> DataFrame:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({k: F.when(when, col(v)).otherwise(F.col(k)).cast(df.schema[k].dataType) for k, v in values.items()})


def _in(ids: DataFrame | list[int], df: DataFrame, key: str = "id") -> tuple[DataFrame, Column]:
    """``df`` with a flag for rows whose key is among ids, a short list or a table."""
    if not isinstance(ids, DataFrame):
        return df, F.col(key).isin(list(ids))
    flagged = df.join(ids.select(F.col(ids.columns[0]).alias(key), F.lit(True).alias("_in")).distinct(), key, "left").select(*df.columns, "_in")
    return flagged, F.coalesce("_in", F.lit(False))


# ---- photos ----


def set_flag(photos: DataFrame, ids: DataFrame | list[int], flag: str, on: bool) -> DataFrame:
    rows, chosen = _in(ids, photos)
    return _set(rows, chosen, **{flag: int(on)}).select(*photos.columns)


def curation_rows(photos: DataFrame) -> DataFrame:
    return photos.filter("favorite = 1 or hidden = 1").select("path", (F.col("favorite") == 1).alias("favorite"), (F.col("hidden") == 1).alias("hidden"))


def export_curation(photos: DataFrame, path: str) -> int:
    """Write the flagged photos as JSON lines; readers take the folder as one file."""
    rows = curation_rows(photos)
    rows.write.mode("overwrite").json(path)
    return rows.count()


def import_curation(photos: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags of a file joined by path and OR-merged; the second table has the number of matches."""
    own = entries.groupBy("path").agg(F.max(F.col("favorite").cast("int")).alias("_f"), F.max(F.col("hidden").cast("int")).alias("_h"))
    joined = photos.join(own, "path", "left")
    merged = joined.withColumn("favorite", F.greatest("favorite", F.coalesce("_f", F.lit(0)))).withColumn("hidden", F.greatest("hidden", F.coalesce("_h", F.lit(0))))
    return merged.select(*photos.columns), photos.join(own, "path", "left_semi").agg(F.count(F.lit(1)).alias("matched"))


def fill_dates(photos: DataFrame) -> DataFrame:
    """Photos without a capture date get the one in their file's name."""
    return photos.withColumn("taken_ts", F.coalesce("taken_ts", S.filename_date(S.name_of(F.col("path")))))


def set_positions(photos: DataFrame, found: DataFrame) -> DataFrame:
    """Coordinates where there are any (id, lat, lon), and the mark that they were looked for."""
    own = found.select("id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.lit(1).alias("_seen"))
    joined = photos.join(own, "id", "left")
    out = joined.withColumn("lat", F.coalesce("_lat", "lat")).withColumn("lon", F.coalesce("_lon", "lon"))
    if "geo_scanned" in photos.columns:
        out = out.withColumn("geo_scanned", F.coalesce("_seen", "geo_scanned"))
    return out.select(*photos.columns)


def set_status(photos: DataFrame, ids: DataFrame | list[int], status: int) -> DataFrame:
    rows, chosen = _in(ids, photos)
    return _set(rows, chosen, thumb_status=status).select(*photos.columns)


def repair_status(photos: DataFrame) -> DataFrame:
    """Downloads that a crash broke off are cloud photos again."""
    return _set(photos, F.col("thumb_status") == DOWNLOADING, thumb_status=CLOUD)


def publish_if_current(photos: DataFrame, results: DataFrame) -> DataFrame:
    """Status of finished jobs (id, path, cache_key, status), where the file is still the same."""
    token = ["id", "path", "cache_key"]
    joined = photos.join(results.select(*token, F.col("status").alias("_status")), token, "left")
    return _set(joined, F.col("_status").isNotNull(), thumb_status=F.col("_status")).select(*photos.columns)


def latest_by_key(table: DataFrame, updates: DataFrame) -> DataFrame:
    """Key/value rows with updates over them."""
    return table.join(updates, "key", "left_anti").unionByName(updates)


def rearm(photos: DataFrame, faces: DataFrame, ids: DataFrame | list[int]) -> tuple[DataFrame, DataFrame]:
    """Changed photos lose faces and hash, and ready ones are queued again."""
    rows, chosen = _in(ids, photos)
    again = _set(rows, chosen & (F.col("thumb_status") == READY), thumb_status=PENDING)
    out = _set(again, chosen, faces_scanned=0, content_hash=F.lit(None)).select(*photos.columns)
    held, gone = _in(ids, faces, "photo_id")
    return out, held.filter(~gone).select(*faces.columns)


# ---- people ----


def _id(group: int) -> int | None:
    return -group if group < 0 else None


def _own(identity: int | None) -> Column:
    return F.col("identity_id").isNull() | F.col("identity_id").eqNullSafe(F.lit(identity).cast("long"))


def new_identity(identities: DataFrame, name: str | None = None) -> tuple[DataFrame, int]:
    made = (identities.agg(F.max("id")).first()[0] or 0) + 1
    return identities.unionByName(identities.sparkSession.createDataFrame([(made, name)], "id long, name string")), made


def ensure_identity(faces: DataFrame, identities: DataFrame, group: int) -> tuple[DataFrame, DataFrame, int]:
    """The person behind a group; a cluster becomes one, and a cluster without free faces is refused."""
    if group < 0:
        return faces, identities, -group
    free = (F.col("cluster_id") == group) & F.col("identity_id").isNull() & (F.col("ignored") == 0)
    if not faces.filter(free).take(1):
        raise StaleVersion("the group has no faces any more")
    identities, made = new_identity(identities)
    return _set(faces, free, identity_id=made), identities, made


def confirm_group(faces: DataFrame, group: int, identity: int | None) -> DataFrame:
    return _set(faces, (group_key() == group) & _own(identity) & (F.col("ignored") == 0), confirmed=1)


def confirm_identity(faces: DataFrame, identity: int) -> DataFrame:
    return _set(faces, (F.col("identity_id") == identity) & (F.col("ignored") == 0), confirmed=1)


def adopt_unnamed(faces: DataFrame, identities: DataFrame, group: int, identity: int) -> DataFrame:
    """Faces of the group that are confirmed under people without a name go to ``identity``."""
    rows, unnamed = _in(identities.filter("name is null").select(F.col("id").alias("identity_id")), faces, "identity_id")
    return _set(rows, unnamed & (group_key() == group) & (F.col("confirmed") == 1), identity_id=identity).select(*faces.columns)


def merge_group(faces: DataFrame, identities: DataFrame, into: int, group: int) -> tuple[DataFrame, DataFrame]:
    """A group's free, own and tentative faces go to a person; a person left without faces loses its name."""
    moved = (group_key() == group) & (F.col("ignored") == 0) & (_own(_id(group)) | (F.col("confirmed") == 0))
    faces = _set(faces, moved, identity_id=into)
    if group < 0:
        rows, held = _in(faces.filter("identity_id is not null").select("identity_id"), identities)
        identities = _set(rows, (F.col("id") == -group) & ~held, name=F.lit(None)).select(*identities.columns)
    return faces, identities


def name_group(faces: DataFrame, identities: DataFrame, group: int, name: str) -> tuple[DataFrame, DataFrame, int]:
    name = name.strip()
    if not name:
        return faces, _set(identities, F.col("id") == (_id(group) or 0), name=F.lit(None)), group
    faces, identities, own = ensure_identity(faces, identities, group)
    return confirm_identity(faces, own), _set(identities, F.col("id") == own, name=name), -own


def add_links(links: DataFrame, a: int, b: int) -> DataFrame:
    return symmetric(links.unionByName(links.sparkSession.createDataFrame([(a, b)], "a long, b long")))


def new_pairs(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the asked pairs, those that the set lacks."""
    return symmetric(asked).join(symmetric(pairs), ["a", "b"], "left_anti")


def remove_pairs(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    return pairs.join(symmetric(gone), ["a", "b"], "left_anti")


def reject_merge(c: Catalog, a: int, b: int, *, expected: int | None = None) -> Catalog:
    """Two groups are different people: both become confirmed people with a barrier between them."""
    c.check(expected)
    faces, identities, ia = ensure_identity(c.faces, c.identities, a)
    faces, identities, ib = ensure_identity(faces, identities, b)
    faces = confirm_identity(confirm_identity(faces, ia), ib)
    return c.commit(expected, faces=faces, identities=identities, cannot_link=add_links(c.cannot_link, ia, ib))


def not_this_person(c: Catalog, group: int, people: list[int], *, expected: int | None = None) -> Catalog:
    """A group is none of these people: it becomes a person of its own, apart from each."""
    c.check(expected)
    faces, identities, own = ensure_identity(c.faces, c.identities, group)
    links = c.cannot_link
    for person in people:
        links = add_links(links, own, _id(person) or person)
    return c.commit(expected, faces=confirm_identity(faces, own), identities=identities, cannot_link=links)


def is_other_named(faces: DataFrame, identities: DataFrame, group: int, identity: int | None) -> bool:
    if group >= 0 or identity == -group:
        return False
    named = identities.filter((F.col("id") == -group) & F.col("name").isNotNull())
    return bool(faces.filter((F.col("identity_id") == -group) & (F.col("confirmed") == 1)).join(named, F.col("identity_id") == named["id"], "left_semi").take(1))


def absorb(c: Catalog, into: int, groups: list[int], *, expected: int | None = None) -> Catalog:
    """Groups go to a person one after another, except itself and other people with names."""
    c.check(expected)
    faces, identities, own = ensure_identity(c.faces, c.identities, into)
    for group in groups:
        if group in (into, -own) or is_other_named(faces, identities, group, own):
            continue
        faces = confirm_group(adopt_unnamed(faces, identities, group, own), group, _id(group))
        faces, identities = merge_group(faces, identities, own, group)
    return c.commit(expected, faces=faces, identities=identities)


def merge_groups(c: Catalog, a: int, b: int, *, expected: int | None = None) -> Catalog:
    """Two groups are one person; a side with a name stays."""
    c.check(expected)
    names = {r["id"]: r["name"] for r in c.identities.filter(F.col("id").isin([x for x in (_id(a), _id(b)) if x])).collect()}
    into, gone = (b, a) if names.get(_id(b)) and not names.get(_id(a)) else (a, b)
    faces, identities, own = ensure_identity(c.faces, c.identities, into)
    faces, identities = merge_group(faces, identities, own, gone)
    return c.commit(expected, faces=confirm_identity(faces, own), identities=identities)


def resolve_same_photo(c: Catalog, into: int, group: int, same: bool, *, expected: int | None = None) -> Catalog:
    """Two groups in one photo: the same person, whose pairs are exempt from now on, or two."""
    c.check(expected)
    if not same:
        return reject_merge(c, into, group, expected=expected)
    if is_other_named(c.faces, c.identities, group, _id(into)):
        raise ValueError("the group is another person with a name")
    from heliograph.operators.people import cooccurring_pairs

    pairs = cooccurring_pairs(c.faces, into, group).select("a", "b")  # before ids change
    faces, identities, own = ensure_identity(c.faces, c.identities, into)
    faces, identities = merge_group(adopt_unnamed(faces, identities, group, own), identities, own, group)
    return c.commit(expected, faces=confirm_identity(faces, own), identities=identities, same_photo_ok=symmetric(c.same_photo_ok.unionByName(pairs)))


def reassign(c: Catalog, ids: DataFrame | list[int], source: int | None, target: int | None, name: str | None = None, *, expected: int | None = None) -> Catalog:
    """Faces go to a person, or to a new one (an existing one of that name), apart from where they were."""
    c.check(expected)
    faces, identities, links = c.faces, c.identities, c.cannot_link
    if target is None:
        held = identities.filter(F.lower("name") == F.lower(F.lit((name or "").strip()))).join(faces.filter("ignored = 0"), identities["id"] == faces["identity_id"], "left_semi").first()
        identities, own = (identities, held["id"]) if held else new_identity(identities, (name or "").strip() or None)
    else:
        faces, identities, own = ensure_identity(faces, identities, target)
    rows, chosen = _in(ids, faces)
    faces = _set(rows, chosen, identity_id=own, confirmed=1, ignored=0).select(*faces.columns)
    if source is not None and source < 0 and -source != own:
        links = add_links(links, own, -source)
    return c.commit(expected, faces=faces, identities=identities, cannot_link=links)


def set_person(faces: DataFrame, ids: DataFrame | list[int], identity: int) -> DataFrame:
    rows, chosen = _in(ids, faces)
    return _set(rows, chosen, identity_id=identity, confirmed=1).select(*faces.columns)


def detach(faces: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """Faces leave their person and stand in their cluster again."""
    rows, chosen = _in(ids, faces)
    return _set(rows, chosen, identity_id=F.lit(None), confirmed=0).select(*faces.columns)


def ignore(faces: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    rows, chosen = _in(ids, faces)
    return _set(rows, chosen, ignored=1).select(*faces.columns)


def capture(faces: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    rows, chosen = _in(ids, faces)
    return rows.filter(chosen).select("id", "identity_id", "ignored", "confirmed")


def restore(faces: DataFrame, states: DataFrame) -> DataFrame:
    """Captured states over the faces; clusters never change."""
    kept = states.select("id", F.struct("identity_id", "ignored", "confirmed").alias("_was"))
    joined = faces.join(kept, "id", "left")
    fields = {k: F.when(F.col("_was").isNotNull(), F.col(f"_was.{k}")).otherwise(F.col(k)) for k in ("identity_id", "ignored", "confirmed")}
    return joined.withColumns(fields).select(*faces.columns)


def undo(c: Catalog, states: DataFrame, links: DataFrame | None = None, exempt: DataFrame | None = None, name: tuple[int, str | None] | None = None, *, expected: int | None = None) -> Catalog:
    c.check(expected)
    tables = {"faces": restore(c.faces, states)}
    if links is not None:
        tables["cannot_link"] = remove_pairs(c.cannot_link, links)
    if exempt is not None:
        tables["same_photo_ok"] = remove_pairs(c.same_photo_ok, exempt)
    if name is not None:
        tables["identities"] = _set(c.identities, F.col("id") == name[0], name=F.lit(name[1]))
    return c.commit(expected, **tables)


def clear_tentative(faces: DataFrame) -> DataFrame:
    return _set(faces, F.col("confirmed") == 0, identity_id=F.lit(None))


def assign_clusters(faces: DataFrame, decisions: DataFrame) -> DataFrame:
    """Free faces of clusters go to people (g, identity_id), tentatively."""
    to = decisions.select(F.col("g").alias("cluster_id"), F.col("identity_id").alias("_to"))
    joined = faces.join(to, "cluster_id", "left")
    free = F.col("identity_id").isNull() & (F.col("ignored") == 0) & F.col("_to").isNotNull()
    return _set(joined, free, identity_id=F.col("_to")).select(*faces.columns)


def apply_clusters(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """New cluster ids (id, cluster) over the faces."""
    joined = faces.join(labels.select("id", F.col("cluster").alias("_c")), "id", "left")
    return joined.withColumn("cluster_id", F.coalesce("_c", "cluster_id")).select(*faces.columns)


def reset_decisions(faces: DataFrame) -> DataFrame:
    """Nothing the user said is left; every face stands for itself until the next clustering."""
    return _set(faces, F.lit(True), identity_id=F.lit(None), ignored=0, confirmed=0, cluster_id=F.col("id"))


def reset_all_faces(photos: DataFrame, c: Catalog, *, expected: int | None = None) -> Catalog:
    """Nothing about faces is left, and every photo is to be looked through again."""
    c.check(expected)
    none = {n: getattr(c, n).limit(0) for n in ("faces", "identities", "cannot_link", "same_photo_ok")}
    return c.commit(expected, photos=photos.withColumn("faces_scanned", F.lit(UNSCANNED).cast(photos.schema["faces_scanned"].dataType)), **none)


def claim_faces(photos: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The photos with the next ``limit`` of the face queue marked as taken, and those jobs."""
    jobs = photos.filter((F.col("thumb_status") == READY) & (F.col("faces_scanned") == UNSCANNED)).orderBy("id").limit(limit)
    rows, chosen = _in(jobs.select("id"), photos)
    return _set(rows, chosen, faces_scanned=CLAIMED).select(*photos.columns), jobs


def release_claims(photos: DataFrame) -> DataFrame:
    """Photos that a crash left taken are in the queue again."""
    return _set(photos, F.col("faces_scanned") == CLAIMED, faces_scanned=UNSCANNED)


def confirm_into(c: Catalog, ids: DataFrame | list[int], group: int, *, expected: int | None = None) -> tuple[Catalog, DataFrame]:
    """Some faces go to a group's person for good, without a barrier to where they were; and their prior states."""
    c.check(expected)
    prior = capture(c.faces, ids)
    faces, identities, own = ensure_identity(c.faces, c.identities, group)
    return c.commit(expected, faces=set_person(faces, ids, own), identities=identities), prior


def name_faces(c: Catalog, ids: DataFrame | list[int], name: str, *, expected: int | None = None) -> tuple[Catalog, int, DataFrame]:
    """Some faces go to the person of exactly that name, or to a new one; the person, and prior states."""
    c.check(expected)
    name = name.strip()
    if not name:
        raise ValueError("a name is required")
    prior, identities = capture(c.faces, ids), c.identities
    held = identities.filter(F.col("name") == name).join(c.faces.filter("ignored = 0"), identities["id"] == c.faces["identity_id"], "left_semi").agg(F.min("id")).first()[0]
    if held is None:
        identities, held = new_identity(identities, name)
    return c.commit(expected, faces=set_person(c.faces, ids, held), identities=identities), held, prior


def split(c: Catalog, tagged: dict[int, DataFrame | list[int]], others: DataFrame | list[int], *, expected: int | None = None) -> tuple[Catalog, DataFrame]:
    """A mixed group's faces go to people by tag (group: faces), others stand in their cluster again; untagged ones stay.

    The prior states of all of them undo it in one step.
    """
    c.check(expected)
    table = lambda ids: ids.select(F.col(ids.columns[0]).cast("long").alias("id")) if isinstance(ids, DataFrame) else c.faces.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    prior = capture(c.faces, reduce(DataFrame.unionByName, [table(ids) for ids in (*tagged.values(), others)]))
    named = lambda ids: isinstance(ids, DataFrame) or bool(ids)
    for group, ids in tagged.items():
        if named(ids):
            c, _ = confirm_into(c, ids, group)
    return (c.commit(None, faces=detach(c.faces, others)) if named(others) else c), prior

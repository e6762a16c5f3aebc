"""Views of the photo catalogue: filters, timeline, search, counts, worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.plans.params import CLOUD, DOWNLOADING, PENDING, READY


def curation(tag: str) -> Column:
    """The filter of a view; an unknown tag is the timeline's."""
    visible = F.col("hidden") == 0
    return {"favorites": (F.col("favorite") == 1) & visible, "hidden": F.col("hidden") == 1}.get(tag, visible)


def pictured(faces: DataFrame, identities: DataFrame, token: str) -> DataFrame:
    """Photos with a face of a person whose name holds the token."""
    named = identities.filter(F.contains(S.fold(F.col("name")), F.lit(token))).select(F.col("id").alias("identity_id"))
    return faces.filter("ignored = 0").join(named, "identity_id", "left_semi").select(F.col("photo_id").alias("id")).distinct()


def search(photos: DataFrame, query: str | None, faces: DataFrame, identities: DataFrame) -> DataFrame:
    """Rows that every token of the query matches.

    A year from 1900 to 2100 means the year of the photo's date alone. Any other token matches
    the path, a pictured person's name, or the month it begins; accents and case don't count,
    and no character is a wildcard. The year and month are worked out before planning.
    """
    for token in (query or "").split():
        folded = S.fold_literal(token)
        date = S.when_of(S.sort_ts())
        if folded.lstrip("+-").isdigit() and 1900 <= int(folded) <= 2100:
            photos = photos.filter(F.year(date) == int(folded))
            continue
        matches = F.contains(S.fold(F.col("path")), F.lit(folded))
        if month := S.month_number(folded):
            matches |= F.month(date) == month
        people = pictured(faces, identities, folded).withColumn("_pictured", F.lit(True))
        photos = photos.join(people, "id", "left").filter(matches | F.coalesce("_pictured", F.lit(False))).drop("_pictured")
    return photos


def normalized_search(query: str | None) -> str | None:
    return (query or "").strip() or None


def page(photos: DataFrame, offset: int, limit: int, by_date: bool = True) -> DataFrame:
    """A window of the timeline (newest first) or of discovery order; a top-k, not a full sort."""
    rows = photos.select("id", "thumb_status", S.sort_ts().alias("ts"), (F.col("favorite") != 0).alias("favorite"))
    order = [F.desc("ts"), F.desc("id")] if by_date else [F.col("id")]
    return rows.orderBy(*order).offset(offset).limit(limit)


def stats(photos: DataFrame) -> DataFrame:
    return photos.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("thumb_status") == READY).alias("ready"),
        F.count_if(curation("favorites")).alias("favorites"),
        F.count_if(curation("hidden")).alias("hidden"),
    )


def face_progress(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count_if(S.is_settled_row()).alias("scanned"), F.count_if(F.col("thumb_status") == READY).alias("eligible"))


def is_settled(photos: DataFrame) -> bool:
    row = face_progress(photos).first()
    return row["eligible"] > 0 and row["scanned"] >= row["eligible"]


def local() -> Column:
    return ~F.col("thumb_status").isin(CLOUD, DOWNLOADING)


def hash_progress(photos: DataFrame) -> DataFrame:
    """All hashed photos against local ones: hashes of photos that went to the cloud still count."""
    return photos.agg(F.count_if(F.col("content_hash").isNotNull()).alias("hashed"), F.count_if(local()).alias("eligible"))


def worklist(photos: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """The next ids for a background task, in id order."""
    wanted = {
        "hash": F.col("content_hash").isNull() & local(),
        "date": F.col("taken_ts").isNull(),
        "thumb": F.col("thumb_status") == PENDING,
        "faces": (F.col("thumb_status") == READY) & (F.col("faces_scanned") == 0),
        "geo": (F.col("geo_scanned") == 0) & local() if "geo_scanned" in photos.columns else F.lit(False),
    }[kind]
    rows = photos.filter(wanted).select("id", "path").orderBy("id")
    return rows.limit(limit) if limit else rows


def after(photos: DataFrame, last: int, limit: int, status: int = CLOUD) -> DataFrame:
    """The page of ids that follows ``last``."""
    return photos.filter((F.col("thumb_status") == status) & (F.col("id") > last)).select("id", "path").orderBy("id").limit(limit)


def on_this_day(photos: DataFrame, month_day: str, limit: int | None = 300) -> DataFrame:
    """Visible photos really taken on a day of the year (``MM-dd``), newest first; all of them without a limit."""
    rows = photos.filter(F.col("taken_ts").isNotNull() & curation("visible") & (F.date_format(S.when_of(F.col("taken_ts")), "MM-dd") == month_day))
    rows = rows.select("id", "thumb_status", F.col("taken_ts").alias("ts"), (F.col("favorite") != 0).alias("favorite")).orderBy(F.desc("ts"), F.desc("id"))
    return rows if limit is None else rows.limit(limit)


def on_this_day_by_year(day_rows: DataFrame, now_year: int) -> DataFrame:
    """A row a past year, newest first: how many, how long ago, and the newest photo as cover."""
    rows = day_rows.withColumn("year", F.year(S.when_of(F.col("ts")))).filter(F.col("year") < now_year)
    ago = F.lit(now_year) - F.col("year")
    grouped = rows.groupBy("year").agg(F.count(F.lit(1)).alias("photos"), F.max(F.struct("ts", "id"))["id"].alias("cover"))
    return grouped.withColumn("badge", F.concat(ago.cast("string"), F.when(ago == 1, " year ago").otherwise(" years ago"))).orderBy(F.desc("year"))


def lookup(photos: DataFrame, ids: DataFrame) -> DataFrame:
    return photos.join(ids, "id", "left_semi")


def insert_sorted(rows: DataFrame, back: DataFrame) -> DataFrame:
    """A person's rows with some put back where they were, newest first."""
    return rows.unionByName(back.select(*rows.columns)).orderBy(F.desc("ts"), F.desc("id"))


def in_look(rows: DataFrame, looks: DataFrame, look: int | None) -> DataFrame:
    """A person's rows of one look (look, photo_ids); all of them if there is no such look."""
    chosen = looks.filter(F.col("look") == F.lit(look)).select(F.explode("photo_ids").alias("id"))
    return rows if look is None or not chosen.take(1) else rows.join(chosen, "id", "left_semi")


def detail(photos: DataFrame, id_: int) -> DataFrame:
    return photos.filter(F.col("id") == id_).select("id", S.name_of(F.col("path")).alias("name"), S.dir_of(F.col("path")).alias("dir"), "size", S.human_bytes(F.col("size")).alias("label"), S.sort_ts().alias("ts"))


def not_ready(photos: DataFrame, visible: DataFrame) -> DataFrame:
    """Of the rows on screen, those without a thumbnail, and whether they are to be fetched."""
    rows = photos.join(visible, "id", "left_semi").filter(F.col("thumb_status") != READY)
    return rows.select("id", (F.col("thumb_status") == CLOUD).alias("fetch"))


# ---- duplicates ----


def duplicate_groups(photos: DataFrame, limit: int | None = None) -> DataFrame:
    """Visible photos of equal content with the bytes that extra copies take, most first.

    Groups are counted before their copies are gathered, so photos without a copy are never gathered.
    """
    rows = photos.filter(F.col("content_hash").isNotNull() & (F.col("content_hash") != "") & (F.col("hidden") == 0))
    copy = F.struct("id", "path", S.sort_ts().alias("ts"), (F.col("favorite") != 0).alias("favorite"))
    n = F.count(F.lit(1))
    order = [F.desc("wasted_bytes"), F.col("content_hash")]
    groups = rows.groupBy("content_hash").agg((F.max("size") * (n - 1)).alias("wasted_bytes"), n.alias("copies_count")).filter("copies_count > 1")
    if limit:
        groups = groups.orderBy(*order).limit(limit)
    copies = rows.join(groups, "content_hash").groupBy("content_hash", "wasted_bytes", "copies_count")
    return copies.agg(F.array_sort(F.collect_list(copy)).alias("copies")).orderBy(*order)


def keepers(groups: DataFrame) -> DataFrame:
    """The copy to keep in each group, the least suspicious path and then the smallest id, and the others."""
    ranked = F.array_min(F.transform("copies", lambda c: F.struct(S.keeper_penalty(c["path"]).alias("penalty"), c["id"].alias("id"))))
    keep = groups.withColumn("keeper", ranked["id"])
    return keep.select("content_hash", "keeper", F.filter(F.transform("copies", lambda c: c["id"]), lambda i: i != F.col("keeper")).alias("others"))


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """Bytes wasted, groups, and the first copy of the group that wastes most as cover."""
    cover = F.min(F.struct((-F.col("wasted_bytes")).alias("less"), "content_hash", F.get("copies", F.lit(0))["id"].alias("id")))["id"]
    return groups.agg(F.coalesce(F.sum("wasted_bytes"), F.lit(0)).cast("long").alias("wasted"), F.count(F.lit(1)).alias("groups"), cover.alias("cover"))


# ---- places ----


def geo_points(photos: DataFrame) -> DataFrame:
    return photos.filter(F.col("lat").isNotNull() & (F.col("hidden") == 0)).select("id", "lat", "lon", S.sort_ts().alias("ts"))


def geo_bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def in_view(points: DataFrame, west: float, south: float, east: float, north: float, limit: int = 200) -> DataFrame:
    """Newest points in a box; a box that crosses the antimeridian has west beyond east."""
    lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    return points.filter(lon & F.col("lat").between(south, north)).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def year_range(points: DataFrame, years: tuple[int, int] | None) -> DataFrame:
    return points.filter(F.year(S.when_of(F.col("ts"))).between(*years)) if years else points


def year_histogram(points: DataFrame) -> DataFrame:
    """Photos a year with gaps filled; nothing for a single year."""
    years = points.groupBy(F.year(S.when_of(F.col("ts"))).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    span = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).filter("lo < hi").select(F.explode(F.sequence("lo", "hi")).alias("year"))
    return span.join(years, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def geo_tiles(points: DataFrame, zoom: int, radius: int = 64, extent: int = 256, limit: int | None = None) -> DataFrame:
    """Markers of a zoom level: points gathered by Web-Mercator cells of ``radius`` pixels.

    Cells stand in for a greedy radius clustering, so that a level is one aggregation.
    """
    cells = float(2**zoom) * extent / radius
    sin = F.sin(F.radians(F.greatest(F.least(F.col("lat"), F.lit(85.0511)), F.lit(-85.0511))))
    x = (F.col("lon") / 360 + 0.5) * cells
    y = (0.5 - F.log((1 + sin) / (1 - sin)) / (4 * 3.141592653589793)) * cells
    grouped = points.groupBy(F.floor(x).alias("cell_x"), F.floor(y).alias("cell_y"))
    tiles = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.min("id").alias("cover"))
    tiles = tiles.withColumn("badge", S.count_badge(F.col("n")))
    return tiles.orderBy(F.desc("n"), "cell_x", "cell_y").limit(limit) if limit else tiles

"""Registered queries of the media library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.operators import clusters, detector, ingest, library, maps, mutations, pages, people, postings, recognition, vectors
from heliograph.plans.params import SYNTHETIC
from heliograph.sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = X.duck(oracle)
        return f

    return register


TS = "coalesce(taken_ts, mtime)"
DAY = "make_timestamp(CAST({} * 1000000 AS BIGINT))"
DUCK_FOLD = "strip_accents(lower({}))"
READY_ROWS = "id, thumb_status, coalesce(taken_ts, mtime) AS ts, favorite <> 0 AS favorite"


# ---- views, counts, worklists ----


@query(f"SELECT {READY_ROWS} FROM photos WHERE hidden = 0 ORDER BY ts DESC, id DESC LIMIT 200 OFFSET 100")
def timeline_page(spark, d):
    return library.page(X.photos(spark, d).filter(library.curation("visible")), 100, 200)


@query(f"""WITH v AS (SELECT {READY_ROWS} FROM photos WHERE hidden = 0) SELECT * FROM (SELECT * FROM v ORDER BY ts DESC, id DESC LIMIT 40 OFFSET 130)
UNION ALL SELECT * FROM (SELECT * FROM v ORDER BY ts DESC, id DESC LIMIT 40 OFFSET 780)""")
def timeline_deep_pages(spark, d):
    index = pages.timeline(X.photos(spark, d).filter(library.curation("visible")), per_part=100)
    return pages.page(index, 130, 40).unionByName(pages.page(index, 780, 40))


@query(f"SELECT {READY_ROWS} FROM photos WHERE hidden = 0 ORDER BY id LIMIT 200 OFFSET 400")
def discovery_page(spark, d):
    return library.page(X.photos(spark, d).filter(library.curation("anything")), 400, 200, by_date=False)


@query(f"SELECT {READY_ROWS} FROM photos WHERE favorite = 1 AND hidden = 0")
def favorites_view(spark, d):
    return X.photos(spark, d).filter(library.curation("favorites")).select("id", "thumb_status", S.sort_ts().alias("ts"), (F.col("favorite") != 0).alias("favorite"))


@query(f"SELECT {READY_ROWS} FROM photos WHERE hidden = 1")
def hidden_view(spark, d):
    return X.photos(spark, d).filter(library.curation("hidden")).select("id", "thumb_status", S.sort_ts().alias("ts"), (F.col("favorite") != 0).alias("favorite"))


@query("""SELECT count(*) AS total, count(*) FILTER (thumb_status = 1) AS ready, count(*) FILTER (favorite = 1 AND hidden = 0) AS favorites,
 count(*) FILTER (hidden = 1) AS hidden FROM photos""")
def library_stats(spark, d):
    return library.stats(X.photos(spark, d))


@query("SELECT count(*) FILTER (thumb_status = 1 AND faces_scanned = 1) AS scanned, count(*) FILTER (thumb_status = 1) AS eligible FROM photos")
def sweep_progress(spark, d):
    return library.face_progress(X.photos(spark, d))


@query("SELECT count(*) FILTER (content_hash IS NOT NULL) AS hashed, count(*) FILTER (thumb_status NOT IN (3, 4)) AS eligible FROM photos")
def hash_progress(spark, d):
    return library.hash_progress(X.photos(spark, d))


@query("SELECT id, path FROM photos WHERE content_hash IS NULL AND thumb_status NOT IN (3, 4) ORDER BY id LIMIT 100")
def unhashed_worklist(spark, d):
    return library.worklist(X.photos(spark, d), "hash", 100)


@query("SELECT id, path FROM photos WHERE taken_ts IS NULL")
def undated_worklist(spark, d):
    return library.worklist(X.photos(spark, d), "date")


@query("SELECT id, path FROM photos WHERE thumb_status = 0")
def pending_worklist(spark, d):
    return library.worklist(X.photos(spark, d), "thumb")


@query("SELECT id, path FROM photos WHERE thumb_status = 1 AND faces_scanned = 0 ORDER BY id LIMIT 64")
def face_worklist(spark, d):
    return library.worklist(X.photos(spark, d), "faces", 64)


@query("SELECT id, path FROM photos WHERE id % 2 = 0 AND thumb_status NOT IN (3, 4) ORDER BY id LIMIT 100")
def geo_worklist(spark, d):
    return library.worklist(X.photos(spark, d).withColumn("geo_scanned", F.col("id") % 2), "geo", 100)


@query("SELECT id, path FROM photos WHERE thumb_status = 3 AND id > 300 ORDER BY id LIMIT 50")
def cloud_page(spark, d):
    return library.after(X.photos(spark, d), 300, 50)


@query("SELECT id, path, size FROM photos WHERE id % 10 = 0")
def photo_lookup(spark, d):
    photos = X.photos(spark, d)
    return library.lookup(photos, photos.filter("id % 10 = 0").select("id")).select("id", "path", "size")


@query(f"""SELECT id, regexp_replace(path, '^.*/', '') AS name, regexp_extract(path, '^(.+/)', 1) AS dir, size,
 CASE WHEN size >= 1000000 THEN printf('%.1f MB', size / 1e6) WHEN size >= 1000 THEN CAST(CAST(floor(size / 1e3 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' ELSE CAST(size AS VARCHAR) || ' B' END AS label,
 {TS} AS ts FROM photos WHERE id = 77""")
def photo_detail(spark, d):
    return library.detail(X.photos(spark, d), 77)


@query("SELECT id, thumb_status = 3 AS fetch FROM photos WHERE id % 10 IN (0, 2) AND thumb_status <> 1")
def viewport_not_ready(spark, d):
    photos = X.photos(spark, d)
    return library.not_ready(photos, photos.filter("id % 10 in (0, 2)").select("id"))


@query(f"SELECT id, taken_ts AS ts, thumb_status, favorite <> 0 AS favorite FROM photos WHERE hidden = 0 AND taken_ts IS NOT NULL AND strftime({DAY.format('taken_ts')}, '%m-%d') = '06-15' ORDER BY ts DESC, id DESC LIMIT 300")
def on_this_day(spark, d):
    return library.on_this_day(X.photos(spark, d), "06-15")


@query(f"""WITH day AS (SELECT id, taken_ts AS ts, CAST(year({DAY.format('taken_ts')}) AS INTEGER) AS year FROM photos WHERE hidden = 0 AND taken_ts IS NOT NULL AND strftime({DAY.format('taken_ts')}, '%m-%d') = '06-15')
SELECT year, count(*) AS photos, arg_max(id, {{'ts': ts, 'id': id}}) AS cover, (2020 - year) || CASE WHEN 2020 - year = 1 THEN ' year ago' ELSE ' years ago' END AS badge FROM day WHERE year < 2020 GROUP BY year""")
def on_this_day_by_year(spark, d):
    return library.on_this_day_by_year(library.on_this_day(X.photos(spark, d), "06-15", limit=None), 2020)


# ---- search ----


def _search(text: str):
    def run(spark, d):
        photos = X.photos(spark, d).filter(library.curation("visible"))
        return library.search(photos, text, X.faces(spark, d), X.identities(spark)).select("id")

    return run


def _token(folded: str, month: int | None = None) -> str:
    either = [f"contains({DUCK_FOLD.format('path')}, '{folded}')", f"id IN (SELECT f.photo_id FROM faces f JOIN identities i ON i.id = f.identity_id WHERE f.ignored = 0 AND contains({DUCK_FOLD.format('i.name')}, '{folded}'))"]
    if month:
        either.append(f"month({DAY.format(TS)}) = {month}")
    return "(" + " OR ".join(either) + ")"


def _year(y: int) -> str:
    return f"year({DAY.format(TS)}) = {y}"


SEARCHES = {
    "search_text": ("iceland", [_token("iceland")]),
    "search_accents": ("ANGEL fiesta", [_token("angel"), _token("fiesta")]),
    "search_year": ("2011", [_year(2011)]),
    "search_month": ("june", [_token("june", 6)]),
    "search_month_prefix_year": ("jun 2012", [_token("jun", 6), _year(2012)]),
    "search_person": ("mía", [_token("mia")]),
    "search_person_year": ("mia 2015", [_token("mia"), _year(2015)]),
    "search_wildcard_literal": ("100%_off", [_token("100%_off")]),
    "search_two_letters": ("ma", [_token("ma")]),
}
for _name, (_text, _conditions) in SEARCHES.items():
    QUERIES[_name] = _search(_text)
    ORACLES[_name] = X.duck(f"SELECT id FROM photos WHERE hidden = 0 AND {' AND '.join(_conditions)}")


@query(f"SELECT count(*) AS n FROM photos WHERE hidden = 0 AND {_token('june', 6)}")
def search_count(spark, d):
    return QUERIES["search_month"](spark, d).agg(F.count(F.lit(1)).alias("n"))


_MOVED = "CASE WHEN id % 11 = 0 THEN concat('/lib/Iceland june/', {id}) ELSE path END"
_INDEXED = ("search_text", "search_accents", "search_month_prefix_year", "search_person_year", "search_wildcard_literal", "search_two_letters")
_HITS = " UNION ALL ".join(f"SELECT '{name}' AS search, id FROM now WHERE hidden = 0 AND {' AND '.join(SEARCHES[name][1])}" for name in _INDEXED)


@query(f"WITH now AS (SELECT * REPLACE ({_MOVED.format(id='id')} AS path) FROM photos) {_HITS}")
def postings_searches(spark, d):
    """An index of two thirds of the photos, extended by the others and those that were moved since."""
    old, faces, people_ = X.photos(spark, d), X.faces(spark, d), X.identities(spark)
    now = old.withColumn("path", F.expr(_MOVED.format(id="cast(id as string)")))
    index = postings.extend(postings.build(old.filter("id % 3 > 0")), now.filter("id % 3 = 0 or id % 11 = 0"))
    visible = now.filter(library.curation("visible"))
    found = [postings.search(index, visible, SEARCHES[name][0], faces, people_).select(F.lit(name).alias("search"), "id") for name in _INDEXED]
    return reduce(DataFrame.unionByName, found)


@query(f"SELECT id, {DUCK_FOLD.format('path')} AS folded FROM photos")
def folded_paths(spark, d):
    return X.photos(spark, d).select("id", S.fold(F.col("path")).alias("folded"))


@query(f"SELECT id, {DUCK_FOLD.format('path')} AS folded FROM photos")
def folded_paths_udf(spark, d):
    return X.photos(spark, d).select("id", S.fold_exact("path").alias("folded"))


@query("SELECT id, name FROM crowd WHERE contains(strip_accents(lower(name)), 'al n') ORDER BY name, id LIMIT 6")
def people_suggestions(spark, d):
    return people.suggestions(X.named(spark, d), "Ál n")


@query("SELECT id, name FROM crowd WHERE strip_accents(lower(name)) = (SELECT min(strip_accents(lower(name))) FROM crowd) AND id <> 1")
def exact_name_match(spark, d):
    who = X.named(spark, d)
    wanted = who.select(F.min(S.fold(F.col("name")))).first()[0]
    return people.exact_name(who, f" {wanted.upper()} ", exclude=1)


# ---- duplicates ----

GROUPS = """WITH dup AS (SELECT content_hash, max(size) * (count(*) - 1) AS wasted_bytes, count(*) AS copies_count FROM photos
 WHERE content_hash IS NOT NULL AND content_hash <> '' AND hidden = 0 GROUP BY content_hash HAVING count(*) > 1),
copies AS (SELECT p.*, dup.wasted_bytes, dup.copies_count FROM photos p JOIN dup USING (content_hash) WHERE hidden = 0),
kept AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY CASE WHEN regexp_matches(path, '(?i)download|copia|copy|backup|duplicate|\\([0-9]+\\)') THEN 1 ELSE 0 END, id) AS rn FROM copies)
"""


@query(GROUPS + "SELECT content_hash, wasted_bytes, copies_count, id, path FROM copies")
def duplicate_groups(spark, d):
    groups = library.duplicate_groups(X.photos(spark, d))
    return groups.select("content_hash", "wasted_bytes", "copies_count", F.explode("copies").alias("c")).select("content_hash", "wasted_bytes", "copies_count", "c.id", "c.path")


@query(GROUPS + "SELECT content_hash, wasted_bytes FROM dup ORDER BY wasted_bytes DESC, content_hash LIMIT 20")
def duplicate_report(spark, d):
    return library.duplicate_groups(X.photos(spark, d), 20).select("content_hash", "wasted_bytes")


@query(GROUPS + "SELECT content_hash, max(CASE WHEN rn = 1 THEN id END) AS keeper, CAST(count(*) FILTER (rn > 1) AS INTEGER) AS others FROM kept GROUP BY content_hash")
def duplicate_keepers(spark, d):
    kept = library.keepers(library.duplicate_groups(X.photos(spark, d)))
    return kept.select("content_hash", "keeper", F.size("others").alias("others"))


@query(GROUPS + "SELECT CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS wasted, count(*) AS groups, (SELECT id FROM copies ORDER BY wasted_bytes DESC, content_hash, id LIMIT 1) AS cover FROM dup")
def duplicate_waste_total(spark, d):
    return library.duplicate_totals(library.duplicate_groups(X.photos(spark, d)))


# ---- places ----

POINTS = f"WITH points AS (SELECT id, lat, lon, {TS} AS ts FROM photos WHERE lat IS NOT NULL AND hidden = 0)\n"


@query(POINTS + "SELECT * FROM points")
def geo_points(spark, d):
    return library.geo_points(X.photos(spark, d))


@query(POINTS + "SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM points")
def geo_bounds(spark, d):
    return library.geo_bounds(library.geo_points(X.photos(spark, d)))


@query(POINTS + "SELECT * FROM points WHERE (lon >= 150 OR lon <= -150) AND lat BETWEEN -40 AND 40 ORDER BY ts DESC, id DESC LIMIT 200")
def bbox_strip(spark, d):
    return library.in_view(library.geo_points(X.photos(spark, d)), 150, -40, -150, 40)


@query(POINTS + f"SELECT * FROM points WHERE year({DAY.format('ts')}) BETWEEN 2005 AND 2009")
def year_range(spark, d):
    return library.year_range(library.geo_points(X.photos(spark, d)), (2005, 2009))


@query(POINTS + f""", years AS (SELECT CAST(year({DAY.format('ts')}) AS INTEGER) AS year, count(*) AS n FROM points GROUP BY 1),
span AS (SELECT unnest(generate_series((SELECT min(year) FROM years), (SELECT max(year) FROM years))) AS year)
SELECT CAST(span.year AS INTEGER) AS year, coalesce(n, 0) AS n FROM span LEFT JOIN years ON years.year = span.year""")
def year_histogram(spark, d):
    return library.year_histogram(library.geo_points(X.photos(spark, d)))


@query(POINTS + """, cells AS (SELECT id, CAST(floor((lon / 360 + 0.5) * 32) AS BIGINT) AS cell_x,
 CAST(floor((0.5 - ln((1 + sin(radians(greatest(least(lat, 85.0511), -85.0511)))) / (1 - sin(radians(greatest(least(lat, 85.0511), -85.0511))))) / (4 * 3.141592653589793)) * 32) AS BIGINT) AS cell_y FROM points)
SELECT cell_x, cell_y, count(*) AS n, min(id) AS cover FROM cells GROUP BY 1, 2""")
def geo_tiles(spark, d):
    return library.geo_tiles(library.geo_points(X.photos(spark, d)), 3).select("cell_x", "cell_y", "n", "cover")


def _levels_sql() -> str:
    """Every zoom's clusters: a fold over nodes in id order keeps the founders, and nodes join the smallest one near them."""
    steps = ""
    for z in range(maps.MAX_ZOOM, -1, -1):
        r2, prior = maps.reach(z) ** 2, f"level{z + 1}"
        far = "(f.x - {0}.x) * (f.x - {0}.x) + (f.y - {0}.y) * (f.y - {0}.y)"
        steps += f""",
 heads{z} AS (SELECT unnest(list_reduce(list([{{'id': id, 'x': sx // n, 'y': sy // n}}] ORDER BY id), lambda a, e: CASE WHEN len(list_filter(a, lambda f: {far.format("e[1]")} <= {r2})) > 0 THEN a ELSE list_concat(a, e) END)) AS f FROM {prior}),
 owned{z} AS (SELECT m.id, any_value(n) AS n, any_value(sx) AS sx, any_value(sy) AS sy, min(f.id) AS up FROM (SELECT *, sx // n AS x, sy // n AS y FROM {prior}) m JOIN heads{z} ON {far.format("m")} <= {r2} GROUP BY m.id),
 level{z} AS MATERIALIZED (SELECT up AS id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sx) AS BIGINT) AS sx, CAST(sum(sy) AS BIGINT) AS sy FROM owned{z} GROUP BY up)"""
    inside = lambda v: f"CAST(greatest(least(floor(({v}) * {maps.WORLD}), {maps.WORLD - 1}), 0) AS BIGINT)"
    sin = "sin(radians(greatest(least(lat, 85.0511), -85.0511)))"
    placed = f"placed AS (SELECT id, {inside('lon / 360 + 0.5')} AS x, {inside(f'0.5 - ln((1 + {sin}) / (1 - {sin})) / (4 * 3.141592653589793)')} AS y FROM points)"
    every = " UNION ALL ".join(f"SELECT {z} AS zoom, * FROM level{z}" for z in range(maps.MAX_ZOOM + 1))
    return POINTS + f""", {placed},
 level{maps.MAX_ZOOM + 1} AS MATERIALIZED (SELECT min(id) AS id, count(*) AS n, x * count(*) AS sx, y * count(*) AS sy FROM placed GROUP BY x, y){steps},
 every AS ({every}), whole AS (SELECT id, n, max(zoom) AS last FROM every GROUP BY 1, 2)
SELECT CAST(zoom AS INTEGER) AS zoom, id AS cover, n, sx // n AS x, sy // n AS y, CASE WHEN n > 1 THEN CAST(least(last + 1, {maps.MAX_ZOOM}) AS INTEGER) END AS expansion FROM every JOIN whole USING (id, n) WHERE zoom IN (1, 3, 6)"""


@query(_levels_sql())
def map_markers(spark, d):
    levels = maps.levels(library.geo_points(X.photos(spark, d)))
    shown = [maps.markers(levels, zoom).select("zoom", "cover", "n", "x", "y", "expansion") for zoom in (1, 3, 6)]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


# ---- people ----

OVER = "WITH best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY g) AS n FROM pool),\ngroups AS (SELECT g, n AS count, best.id AS cover_face_id, i.name FROM best LEFT JOIN identities i ON i.id = -g WHERE rn = 1)\n"


@query(OVER + "SELECT * FROM groups")
def people_overview(spark, d):
    return people.overview(X.faces(spark, d), X.identities(spark))


@query(OVER + "SELECT * FROM groups ORDER BY name IS NULL, count DESC, g LIMIT 20")
def people_ranked(spark, d):
    return people.ranked_overview(people.overview(X.faces(spark, d), X.identities(spark))).limit(20)


@query(OVER + "SELECT g, count, CASE WHEN name IS NOT NULL OR count >= 2 THEN 'tile' ELSE 'tail' END AS shelf FROM groups")
def people_shelves(spark, d):
    return people.listed(people.overview(X.faces(spark, d), X.identities(spark)), settled=True).select("g", "count", "shelf")


@query(OVER + "SELECT g, count FROM groups WHERE name IS NULL AND count >= 2 AND g % 2 <> 0 ORDER BY count DESC, g LIMIT 1")
def new_person(spark, d):
    groups = people.overview(X.faces(spark, d), X.identities(spark))
    return people.new_person(groups, groups.filter("g % 2 = 0").select("g"), floor=2).select("g", "count")


@query(OVER + "SELECT g, CAST(rn AS INTEGER) AS rank, id, score FROM best WHERE rn <= 4")
def top_faces_per_group(spark, d):
    return people.top_faces(X.faces(spark, d), 4)


@query("SELECT id, score FROM pool WHERE g = -1")
def group_faces(spark, d):
    return people.group_faces(X.faces(spark, d), -1)


@query("SELECT f.id, coalesce(-identity_id, cluster_id) AS g, i.name, score, x1, y1, x2, y2 FROM faces f LEFT JOIN identities i ON i.id = f.identity_id WHERE photo_id = 12 AND ignored = 0")
def faces_in_photo(spark, d):
    return people.faces_in_photo(X.faces(spark, d), X.identities(spark), 12)


@query("SELECT id FROM pool WHERE g = -2 AND photo_id % 2 = 0")
def group_in_photos(spark, d):
    return people.group_in_photos(X.faces(spark, d), -2, X.photos(spark, d).filter("id % 2 = 0").select(F.col("id").alias("photo_id")))


@query(f"SELECT {READY_ROWS} FROM photos WHERE id IN (SELECT photo_id FROM pool WHERE g = -1)")
def person_photos(spark, d):
    return people.person_photos(X.photos(spark, d), X.faces(spark, d), -1)


@query(f"SELECT p.id, photo_id, {TS} AS ts, score FROM pool p JOIN photos ON photos.id = p.photo_id WHERE g = -1")
def person_faces(spark, d):
    return people.person_faces(X.photos(spark, d), X.faces(spark, d), -1)


@query("SELECT a.photo_id, a.id AS a, b.id AS b FROM pool a JOIN pool b ON a.photo_id = b.photo_id WHERE a.g = -1 AND b.g = -2")
def cooccurring_pairs(spark, d):
    return people.cooccurring_pairs(X.faces(spark, d), -1, -2)


@query("SELECT photo_id, id, x1, y1, x2, y2 FROM pool WHERE photo_id IN (SELECT photo_id FROM pool GROUP BY photo_id HAVING count(*) > 1)")
def multi_face_boxes(spark, d):
    return people.multi_face_boxes(X.faces(spark, d))


@query("""WITH pairs AS (SELECT a.id AS a, b.id AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0) AS inter,
 (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas FROM pool a JOIN pool b ON a.photo_id = b.photo_id AND a.id < b.id)
SELECT a, b, round(inter / greatest(areas - inter, 1e-9), 6) AS iou FROM pairs WHERE inter / greatest(areas - inter, 1e-9) >= 0.1""")
def double_detections(spark, d):
    return people.double_detections(X.faces(spark, d), 0.1).select("a", "b", F.round("iou", 6).alias("iou"))


IMPLICIT = "SELECT a.id AS a, b.id AS b FROM crowd a JOIN crowd b ON a.id < b.id AND a.name <> b.name"


@query(IMPLICIT)
def implicit_cannot_links(spark, d):
    return people.implicit_cannot_links(X.named(spark, d))


@query(f"SELECT a, b FROM apart UNION ({IMPLICIT})")
def constraint_union(spark, d):
    return people.cannot_links(X.apart(spark, d), X.named(spark, d))


VETO = "SELECT DISTINCT p.g, c.identity_id FROM pool p JOIN faces c ON c.photo_id = p.photo_id WHERE c.confirmed = 1 AND c.ignored = 0 AND c.identity_id IS NOT NULL AND p.g <> -c.identity_id"


@query(VETO)
def cooccurrence_veto(spark, d):
    return people.cooccurrence(X.faces(spark, d))


@query("SELECT identity_id, count(*) AS n FROM faces WHERE confirmed = 1 AND identity_id IS NOT NULL AND ignored = 0 GROUP BY 1 HAVING count(*) >= 4")
def fold_eligible(spark, d):
    return people.confirmed_counts(X.faces(spark, d), 4)


@query("SELECT -id AS g FROM identities WHERE lower(name) = 'omar' AND id IN (SELECT identity_id FROM faces WHERE ignored = 0)")
def group_for_name(spark, d):
    return people.group_for_name(X.faces(spark, d), X.identities(spark), " OMAR ")


@query("SELECT -f.identity_id AS g, count(*) AS faces FROM faces f JOIN identities i ON i.id = f.identity_id WHERE f.confirmed = 1 AND i.name IS NOT NULL AND f.identity_id <> 1 GROUP BY 1")
def other_named_people(spark, d):
    return people.other_named_person(X.faces(spark, d), X.identities(spark), 1)


# ---- vectors ----

DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def knn_sql(table: str, tau: float, k: int = 10) -> str:
    return f"""near AS (SELECT * FROM (SELECT a.id AS i, b.id AS j, {DOT} AS sim, row_number() OVER (PARTITION BY a.id ORDER BY {DOT} DESC, b.id) AS rank
 FROM {table} a JOIN {table} b ON a.id <> b.id WHERE {DOT} >= {tau}) WHERE rank <= {k})"""


def _near(spark, d, tau, only_pool=False):
    faces = X.faces(spark, d)
    return vectors.knn(people.pool(faces) if only_pool else faces, 10, tau)


@query("WITH " + knn_sql("faces", 0.25) + " SELECT i, j, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM near")
def knn_topk(spark, d):
    return _near(spark, d, 0.25).select("i", "j", F.round("sim", 6).alias("sim"), "rank")


@query("WITH " + knn_sql("faces", 0.35) + " SELECT least(i, j) AS a, greatest(i, j) AS b, round(max(sim), 6) AS sim FROM near GROUP BY 1, 2")
def candidate_edges(spark, d):
    return vectors.candidate_edges(_near(spark, d, 0.35)).select("a", "b", F.round("sim", 6).alias("sim"))


@query("WITH " + knn_sql("faces", 0.3) + " SELECT x.i AS a, x.j AS b, round(x.sim, 6) AS sim FROM near x JOIN near y ON x.i = y.j AND x.j = y.i WHERE x.i < x.j")
def mutual_edges(spark, d):
    return vectors.mutual_edges(_near(spark, d, 0.3)).select("a", "b", F.round("sim", 6).alias("sim"))


@query("WITH " + knn_sql("faces", 0.3) + """, m AS (SELECT CAST(least(greatest(floor((x.sim - 0.3) / 0.05), 0), 13) AS INTEGER) AS bucket FROM near x JOIN near y ON x.i = y.j AND x.j = y.i WHERE x.i < x.j)
SELECT bucket, count(*) AS n, repeat('#', least(count(*), 60)) AS bar FROM m GROUP BY 1""")
def edge_histogram(spark, d):
    return vectors.edge_histogram(vectors.mutual_edges(_near(spark, d, 0.3)))


EVIDENCE = knn_sql("pool", 0.35) + """, evidence AS (SELECT least(a.g, b.g) AS a, greatest(a.g, b.g) AS b, count(*) AS pairs, max(sim) AS max_sim FROM near JOIN pool a ON a.id = i JOIN pool b ON b.id = j WHERE i < j AND a.g <> b.g GROUP BY 1, 2 HAVING count(*) >= 1)"""


@query("WITH " + EVIDENCE + " SELECT a, b, pairs, round(max_sim, 6) AS max_sim FROM evidence")
def merge_evidence(spark, d):
    pool = people.pool(X.faces(spark, d))
    return vectors.merge_evidence(_near(spark, d, 0.35, True), pool, 1).select("a", "b", "pairs", F.round("max_sim", 6).alias("max_sim"))


ANCHORED = """anchors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY score DESC, id) AS rn FROM faces WHERE confirmed = 1 AND ignored = 0 AND identity_id IS NOT NULL) WHERE rn <= 64),
sims AS (SELECT p.id, p.g, a.identity_id, list_inner_product(p.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS s FROM {pool} p JOIN anchors a ON p.g <> -a.identity_id),
top AS (SELECT id, g, identity_id, list_slice(list_reverse_sort(list(s)), 1, 3) AS best FROM sims GROUP BY id, g, identity_id),
scored AS (SELECT *, list_sum(best) / len(best) AS score FROM top),
matches AS (SELECT identity_id, g, count(*) AS size, count(*) FILTER (score >= 0.1) AS matched, max(score) FILTER (score >= 0.1) AS max_sim FROM scored GROUP BY 1, 2
 HAVING 2 * count(*) FILTER (score >= 0.1) >= count(*) AND count(*) FILTER (score >= 0.1) >= greatest(1, least(2, count(*))))"""
#: Anchors and groups of the synthetic vectors are hardly alike; at this bar there is something to decide.
LOOSE = SYNTHETIC.__class__(**{**SYNTHETIC.__dict__, "link": 0.1, "fold_min": 0.15, "strong": 0.2})


@query("WITH " + ANCHORED.format(pool="pool") + " SELECT identity_id, g, size, matched, round(max_sim, 6) AS max_sim FROM matches")
def anchor_scores(spark, d):
    return recognition.matches(X.faces(spark, d), LOOSE, trim=False).select("identity_id", "g", "size", "matched", F.round("max_sim", 6).alias("max_sim"))


CLEAN = "clean AS (SELECT * REPLACE (CASE WHEN confirmed = 1 THEN identity_id END AS identity_id) FROM faces), cpool AS (SELECT *, coalesce(-identity_id, cluster_id) AS g FROM clean WHERE cluster_id IS NOT NULL AND ignored = 0)"


@query("WITH " + CLEAN + ", " + ANCHORED.format(pool="cpool") + """, ranked AS (SELECT *, row_number() OVER w AS rn, lead(max_sim) OVER w AS second FROM matches WHERE g > 0 WINDOW w AS (PARTITION BY g ORDER BY max_sim DESC, identity_id)),
able AS (SELECT identity_id FROM faces WHERE confirmed = 1 AND ignored = 0 GROUP BY 1 HAVING count(*) >= 3),
veto AS (SELECT DISTINCT p.g, c.identity_id FROM cpool p JOIN clean c ON c.photo_id = p.photo_id WHERE c.confirmed = 1 AND c.ignored = 0 AND c.identity_id IS NOT NULL AND p.g <> -c.identity_id)
SELECT g, identity_id, round(max_sim, 6) AS sim FROM ranked WHERE rn = 1 AND max_sim >= 0.15 AND (second IS NULL OR max_sim - second >= 0.02) AND identity_id IN (SELECT identity_id FROM able)
 AND NOT EXISTS (SELECT 1 FROM veto v WHERE v.g = ranked.g AND v.identity_id = ranked.identity_id)""")
def auto_fold_decisions(spark, d):
    return recognition.fold_decisions(X.faces(spark, d), LOOSE, trim=False).select("g", "identity_id", F.round("sim", 6).alias("sim"))


CLAIMS = ANCHORED.format(pool="pool") + f""", named AS (SELECT id AS identity_id, name FROM identities WHERE name IS NOT NULL AND id IN (SELECT identity_id FROM anchors GROUP BY 1 HAVING count(*) >= 3)),
veto AS ({VETO}),
own AS (SELECT m.*, n.name FROM matches m JOIN named n USING (identity_id) WHERE m.g > 0 AND NOT EXISTS (SELECT 1 FROM veto v WHERE v.g = m.g AND v.identity_id = m.identity_id)
 AND NOT EXISTS (SELECT 1 FROM matches o WHERE o.g = m.g AND o.identity_id <> m.identity_id AND o.max_sim > m.max_sim + 0.02)),
claims AS (SELECT identity_id, name, g, size AS photos, max_sim AS sim, count(*) OVER (PARTITION BY g) AS claimants FROM own),
cards AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity_id, tier ORDER BY photos DESC, sim DESC, g) AS rank FROM (SELECT *, CASE WHEN sim >= 0.2 THEN 'strong' ELSE 'maybe' END AS tier FROM claims WHERE claimants = 1)) WHERE tier = 'strong' OR rank <= 12)"""


def _claims(spark, d):
    return recognition.growth_claims(X.faces(spark, d), X.identities(spark), LOOSE, trim=False)


@query("WITH " + CLAIMS + " SELECT identity_id, name, g, photos, round(sim, 6) AS sim, claimants FROM claims")
def growth_claims(spark, d):
    return _claims(spark, d).withColumn("sim", F.round("sim", 6))


@query("WITH " + CLAIMS + " SELECT identity_id, name, g, photos, round(sim, 6) AS sim, tier, CAST(rank AS INTEGER) AS rank FROM cards")
def growth_cards(spark, d):
    return recognition.growth_cards(_claims(spark, d), LOOSE).withColumn("sim", F.round("sim", 6))


@query("WITH " + CLAIMS + " SELECT g, max(photos) AS photos, list_slice(list(identity_id ORDER BY sim DESC, identity_id), 1, 3) AS candidates FROM claims WHERE claimants >= 2 GROUP BY g")
def who_is_this(spark, d):
    return recognition.who_is_this(_claims(spark, d))


MERGES = EVIDENCE + """, sizes AS (SELECT g, count(*) AS n, max(i.name) AS name FROM pool LEFT JOIN identities i ON i.id = -g GROUP BY g),
strongest AS (SELECT e.*, x.n AS xn, y.n AS yn, x.name AS xname, y.name AS yname, max_sim * pairs * sqrt(x.n + y.n) AS leverage FROM evidence e JOIN sizes x ON x.g = e.a JOIN sizes y ON y.g = e.b ORDER BY leverage DESC, a, b LIMIT 20),
sided AS (SELECT CASE WHEN xn >= yn THEN a ELSE b END AS target, CASE WHEN xn >= yn THEN b ELSE a END AS source, CASE WHEN xn >= yn THEN xname ELSE yname END AS target_name, CASE WHEN xn >= yn THEN yname ELSE xname END AS source_name, max_sim AS similarity, least(xn, yn) AS photos FROM strongest),
open AS (SELECT s.* FROM sided s WHERE (target_name IS NULL OR source_name IS NULL) AND NOT (target < 0 AND source < 0 AND EXISTS (SELECT 1 FROM cannot_link c WHERE c.a = least(-target, -source) AND c.b = greatest(-target, -source)))),
met AS (SELECT o.target, o.source, min(x.photo_id) AS photo_id FROM open o JOIN pool x ON x.g = o.target JOIN pool y ON y.g = o.source AND y.photo_id = x.photo_id GROUP BY 1, 2),
merges AS (SELECT CASE WHEN m.photo_id IS NULL THEN 'pairwise' ELSE 'twin' END AS kind, o.target, o.source, o.target_name, o.similarity, o.photos, m.photo_id FROM open o LEFT JOIN met m ON m.target = o.target AND m.source = o.source
 WHERE m.photo_id IS NULL OR (o.similarity >= 0.35 AND NOT (o.source < 0 AND EXISTS (SELECT 1 FROM faces f WHERE f.identity_id = -o.source AND f.confirmed = 1) AND o.source_name IS NOT NULL)))"""


def _merges(spark, d):
    return recognition.merge_suggestions(X.photos(spark, d), X.faces(spark, d), X.identities(spark), X.cannot_link(spark), LOOSE)


@query("WITH " + MERGES + " SELECT kind, target, source, target_name, round(similarity, 6) AS similarity, photos, photo_id FROM merges")
def merge_suggestions(spark, d):
    return _merges(spark, d).withColumn("similarity", F.round("similarity", 6))


@query("WITH " + MERGES.replace("WITH ", "") + ", " + CLAIMS + """, items AS (
 SELECT 0 AS ord, 'who' AS kind, g AS subject, NULL::BIGINT AS other, max(photos) AS photos FROM claims WHERE claimants >= 2 GROUP BY g
 UNION ALL SELECT 1, 'twin', photo_id, NULL, CAST(sum(photos) AS BIGINT) FROM merges WHERE kind = 'twin' GROUP BY photo_id
 UNION ALL SELECT 2, 'strong', -identity_id, NULL, CAST(sum(photos) AS BIGINT) FROM cards WHERE tier = 'strong' GROUP BY identity_id
 UNION ALL SELECT 3, 'maybe', -identity_id, g, photos FROM cards WHERE tier = 'maybe'
 UNION ALL SELECT 4, 'pairwise', target, source, photos FROM merges WHERE kind = 'pairwise')
SELECT * FROM items WHERE photos >= 1 ORDER BY photos DESC, ord, subject, other NULLS FIRST LIMIT 60""")
def review_queue(spark, d):
    return recognition.review_queue(_claims(spark, d), _merges(spark, d), LOOSE)


# ---- clustering: invariants, and rows ----


def _clusters(spark, d):
    faces = X.faces(spark, d)
    named = faces.filter("confirmed = 1").select("id", "identity_id").join(X.identities(spark).select(F.col("id").alias("identity_id"), "name"), "identity_id", "left")
    return faces, clusters.recluster(faces, SYNTHETIC, faces.select("id", "photo_id"), named, X.cannot_link(spark), people.double_detections(faces, 0.4).select("a", "b"))


#: One edge a step, strongest first: groups join unless any two of their faces are unlike or kept apart.
CLUSTERED = "WITH RECURSIVE " + knn_sql("faces", SYNTHETIC.link) + """,
strong AS (SELECT least(i, j) AS a, greatest(i, j) AS b, max(sim) AS sim FROM near GROUP BY 1, 2),
ids AS (SELECT id, row_number() OVER (ORDER BY id) AS p FROM (SELECT a AS id FROM strong UNION SELECT b FROM strong)),
edges AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sim DESC, a, b) AS k, x.p AS a, y.p AS b FROM strong JOIN ids x ON x.id = a JOIN ids y ON y.id = b),
people AS (SELECT ids.p, f.id, f.photo_id, f.embedding, CASE WHEN f.confirmed = 1 THEN f.identity_id END AS person, CASE WHEN f.confirmed = 1 THEN i.name END AS name FROM ids JOIN faces f ON f.id = ids.id LEFT JOIN identities i ON i.id = f.identity_id),
boxes AS (SELECT a.id AS a, b.id AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0) AS inter,
 (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas FROM pool a JOIN pool b ON a.photo_id = b.photo_id AND a.id < b.id),
twice AS (SELECT a, b FROM boxes WHERE inter / greatest(areas - inter, 1e-9) >= 0.4),
bad AS (SELECT a.p AS x, b.p AS y, """ + DOT + f""" < {SYNTHETIC.link} OR (a.photo_id = b.photo_id AND NOT EXISTS (SELECT 1 FROM twice t WHERE t.a = least(a.id, b.id) AND t.b = greatest(a.id, b.id)))
 OR EXISTS (SELECT 1 FROM cannot_link c WHERE c.a = least(a.person, b.person) AND c.b = greatest(a.person, b.person)) OR coalesce(a.person <> b.person AND a.name <> b.name, false) AS apart FROM people a JOIN people b ON a.p <> b.p),
sided AS (SELECT x, list_prepend(false, list(apart ORDER BY y)) AS row FROM (SELECT * FROM bad UNION ALL SELECT p, p, false FROM ids) GROUP BY x),
matrix AS MATERIALIZED (SELECT list(row ORDER BY x) AS apart, len(list(x)) AS m FROM sided),
steps AS (SELECT 0::BIGINT AS k, (SELECT list(p ORDER BY p) FROM ids) AS g
 UNION ALL SELECT e.k, CASE WHEN g[e.a] = g[e.b] OR len(list_filter(range(1, m + 1), lambda x: g[x] = g[e.a] AND len(list_filter(range(1, m + 1), lambda y: g[y] = g[e.b] AND apart[x][y + 1])) > 0)) > 0 THEN g
  ELSE list_transform(g, lambda v: CASE WHEN v = greatest(g[e.a], g[e.b]) THEN least(g[e.a], g[e.b]) ELSE v END) END FROM steps s JOIN edges e ON e.k = s.k + 1, matrix),
last AS (SELECT unnest(g) AS g, unnest(range(1, len(g) + 1)) AS p FROM (SELECT g FROM steps ORDER BY k DESC LIMIT 1)),
firsts AS (SELECT f.id, coalesce(h.id, f.id) AS first FROM faces f LEFT JOIN ids ON ids.id = f.id LEFT JOIN last ON last.p = ids.p LEFT JOIN ids h ON h.p = last.g),
labels AS (SELECT id, dense_rank() OVER (ORDER BY first) AS cluster FROM firsts)
"""


#: A vector as the three grids of a 64 pixel detector: its numbers, over and over.
TENSORS = """SELECT vec_id AS photo_id, 40 + vec_id % 100 AS width, 30 + vec_id % 130 AS height, stride, transform(cells, i -> 0.5e0 + 3 * CAST(embedding[i % 64] AS DOUBLE)) AS cls, transform(cells, i -> 0.5e0 + 3 * CAST(embedding[(i + 7) % 64] AS DOUBLE)) AS obj,
 transform(flatten(transform(cells, i -> array(4 * i, 4 * i + 1, 4 * i + 2, 4 * i + 3))), i -> CAST(embedding[i % 64] AS DOUBLE)) AS bbox, transform(sequence(0, 10 * size(cells) - 1), i -> CAST(embedding[(3 * i + 1) % 64] AS DOUBLE)) AS kps
FROM (SELECT *, sequence(0, CAST((64 / stride) * (64 / stride) AS INT) - 1) AS cells FROM (SELECT *, explode(array(8, 16, 32)) AS stride FROM {embeddings} WHERE size(embedding) = 64))"""


@query("""WITH base AS (SELECT vec_id AS photo_id, 40 + vec_id % 100 AS width, 30 + vec_id % 130 AS height, embedding AS e, unnest([8, 16, 32]) AS stride FROM embeddings WHERE len(embedding) = 64),
grid AS (SELECT *, unnest(range(0, CAST((64 // stride) * (64 // stride) AS BIGINT))) AS cell, 64e0 / greatest(width, height) AS scale FROM base),
scored AS (SELECT *, (0.5e0 + 3 * e[1 + cell % 64]::DOUBLE) * (0.5e0 + 3 * e[1 + (cell + 7) % 64]::DOUBLE) AS score, floor((64 - least(greatest(floor(width * scale + 0.5), 1), 64)) / 2) AS px, floor((64 - least(greatest(floor(height * scale + 0.5), 1), 64)) / 2) AS py,
 cell % (64 // stride) + e[1 + (4 * cell) % 64]::DOUBLE AS x, cell // (64 // stride) + e[1 + (4 * cell + 1) % 64]::DOUBLE AS y, exp(e[1 + (4 * cell + 2) % 64]::DOUBLE) / 2 AS w, exp(e[1 + (4 * cell + 3) % 64]::DOUBLE) / 2 AS h FROM grid)
SELECT photo_id, stride, CAST(cell AS INTEGER) AS cell, round(score, 6) AS score, round(((x - w) * stride - px) / scale / width, 6) AS x1, round(((y - h) * stride - py) / scale / height, 6) AS y1,
 round(((x + w) * stride - px) / scale / width, 6) AS x2, round(((y + h) * stride - py) / scale / height, 6) AS y2, round(((cell % (64 // stride) + e[1 + (3 * (10 * cell + 4) + 1) % 64]::DOUBLE) * stride - px) / scale, 6) AS nose_x FROM scored WHERE score >= 0.6""")
def detected_candidates(spark, d):
    outputs = spark.sql(TENSORS, embeddings=X.table(spark, d, "embeddings"))
    found = detector.candidates(outputs, 64)
    rounded = [F.round(c, 6).alias(c) for c in ("score", "x1", "y1", "x2", "y2")]
    return found.select("photo_id", "stride", "cell", *rounded, F.round(F.col("landmarks")[2]["x"], 6).alias("nose_x"))


@query(CLUSTERED + "SELECT id, cluster FROM labels")
def cluster_labels(spark, d):
    return _clusters(spark, d)[1]


@query("SELECT CAST(0 AS BIGINT) AS violations")
def cluster_clique_violations(spark, d):
    faces, label = _clusters(spark, d)
    a = faces.join(label, "id").select("id", "cluster", "embedding")
    b = a.select(F.col("id").alias("b"), "cluster", F.col("embedding").alias("w"))
    return a.join(b, "cluster").filter((F.col("id") < F.col("b")) & (vectors.dot(F.col("embedding"), F.col("w")) < SYNTHETIC.link - 1e-9)).agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def cluster_constraint_violations(spark, d):
    faces, label = _clusters(spark, d)
    a = faces.join(label, "id").select("id", "cluster", "photo_id", F.when(F.col("confirmed") == 1, F.col("identity_id")).alias("p"))
    b = a.select(F.col("id").alias("b"), "cluster", F.col("photo_id").alias("b_photo"), F.col("p").alias("q"))
    ok = people.double_detections(faces, 0.4).select(F.col("a").alias("id"), "b")
    pairs = a.join(b, "cluster").filter("id < b and (photo_id = b_photo or (p is not null and q is not null and p <> q and p < 5 and q < 5))")
    return pairs.join(ok, ["id", "b"], "left_anti").agg(F.count(F.lit(1)).alias("violations"))


@query(CLUSTERED + "SELECT cluster, count(*) AS faces FROM labels GROUP BY cluster")
def cluster_sizes(spark, d):
    return _clusters(spark, d)[1].groupBy("cluster").agg(F.count(F.lit(1)).alias("faces"))


@query()
def looks_by_person(spark, d):
    faces = people.pool(X.faces(spark, d)).filter("g < 0").join(X.photos(spark, d).select(F.col("id").alias("photo_id"), S.sort_ts().alias("ts")), "photo_id")
    return clusters.looks(faces, 0.2)


@query()
def incremental_assign(spark, d):
    faces = X.faces(spark, d)
    return clusters.assign_batch(faces.filter("id % 5 <> 0"), faces.filter("id % 5 = 0"), SYNTHETIC)


@query("WITH mean AS (SELECT identity_id, list(v ORDER BY pos) AS v FROM (SELECT identity_id, pos, sum(embedding[pos]::DOUBLE) AS v FROM faces, range(1, 65) r(pos) WHERE identity_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) SELECT identity_id, CAST(p - 1 AS INTEGER) AS pos, round(v[p] / sqrt(list_inner_product(v, v)), 6) AS x FROM mean, range(1, 65) r(p)")
def mean_vectors(spark, d):
    means = vectors.mean_normalized(X.faces(spark, d).filter("identity_id is not null"), "identity_id")
    return means.select("identity_id", F.posexplode("mean").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query()
def suppressed_boxes(spark, d):
    return clusters.suppressed(X.faces(spark, d), 0.1)


# ---- changes ----


@query("SELECT id, CASE WHEN coalesce(-identity_id, cluster_id) = -2 AND ignored = 0 AND (identity_id IS NULL OR identity_id = 2 OR confirmed = 0) THEN 1 ELSE identity_id END AS identity_id, confirmed, cluster_id FROM faces")
def mutation_merge(spark, d):
    faces, _ = mutations.merge_group(X.faces(spark, d), X.identities(spark), 1, -2)
    return faces.select("id", "identity_id", "confirmed", "cluster_id")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE identity_id END AS identity_id, CASE WHEN id % 4 = 0 THEN 0 ELSE confirmed END AS confirmed FROM faces")
def mutation_detach(spark, d):
    faces = X.faces(spark, d)
    return mutations.detach(faces, faces.filter("id % 4 = 0").select("id")).select("id", "identity_id", "confirmed")


@query("""SELECT 'changed' AS state, id, CASE WHEN id % 3 = 0 THEN 4 ELSE identity_id END AS identity_id, CASE WHEN id % 3 = 0 THEN 1 ELSE ignored END AS ignored, CASE WHEN id % 3 = 0 THEN 1 ELSE confirmed END AS confirmed FROM faces
UNION ALL SELECT 'restored', id, identity_id, ignored, confirmed FROM faces""")
def mutation_undo_roundtrip(spark, d):
    faces = X.faces(spark, d)
    ids = faces.filter("id % 3 = 0").select("id")
    changed = mutations.ignore(mutations.set_person(faces, ids, 4), ids)
    rows = lambda df, state: df.select(F.lit(state).alias("state"), "id", "identity_id", "ignored", "confirmed")
    return rows(changed, "changed").unionByName(rows(mutations.restore(changed, mutations.capture(faces, ids)), "restored"))


@query("SELECT id, CASE WHEN confirmed = 1 THEN identity_id END AS identity_id FROM faces")
def mutation_clear_tentative(spark, d):
    return mutations.clear_tentative(X.faces(spark, d)).select("id", "identity_id")


@query("SELECT id, CASE WHEN coalesce(-identity_id, cluster_id) = -3 AND (identity_id IS NULL OR identity_id = 3) AND ignored = 0 THEN 1 ELSE confirmed END AS confirmed FROM faces")
def mutation_confirm(spark, d):
    return mutations.confirm_group(X.faces(spark, d), -3, 3).select("id", "confirmed")


@query("SELECT id, CASE WHEN coalesce(-identity_id, cluster_id) = -5 AND confirmed = 1 THEN 2 ELSE identity_id END AS identity_id FROM faces")
def mutation_adopt(spark, d):
    return mutations.adopt_unnamed(X.faces(spark, d), X.identities(spark), -5, 2).select("id", "identity_id")


@query("SELECT id, id AS cluster_id, CAST(NULL AS BIGINT) AS identity_id, 0 AS confirmed, 0 AS ignored FROM faces")
def mutation_reset(spark, d):
    return mutations.reset_decisions(X.faces(spark, d)).select("id", "cluster_id", "identity_id", "confirmed", "ignored")


@query("SELECT id, CASE WHEN id % 6 = 0 THEN 1 ELSE favorite END AS favorite FROM photos")
def mutation_favorite(spark, d):
    photos = X.photos(spark, d)
    return mutations.set_flag(photos, photos.filter("id % 6 = 0").select("id"), "favorite", True).select("id", "favorite")


@query("SELECT id, CASE WHEN thumb_status = 4 THEN 3 ELSE thumb_status END AS thumb_status FROM photos")
def status_repair(spark, d):
    return mutations.repair_status(X.photos(spark, d)).select("id", "thumb_status")


@query("SELECT id, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 1 ELSE thumb_status END AS thumb_status FROM photos")
def publish_if_current(spark, d):
    photos = X.photos(spark, d).withColumn("cache_key", F.md5("path"))
    jobs = photos.filter("id % 5 = 0").select("id", "path", F.when(F.col("id") % 2 == 0, F.col("cache_key")).otherwise("old").alias("cache_key"), F.lit(1).alias("status"))
    return mutations.publish_if_current(photos, jobs).select("id", "thumb_status")


@query("SELECT path, favorite = 1 AS favorite, hidden = 1 AS hidden FROM photos WHERE favorite = 1 OR hidden = 1")
def curation_export(spark, d):
    return mutations.curation_rows(X.photos(spark, d))


@query("SELECT id, greatest(favorite, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) AS favorite, greatest(hidden, CASE WHEN id % 7 = 0 AND id % 2 = 0 THEN 1 ELSE 0 END) AS hidden FROM photos")
def curation_import(spark, d):
    photos = X.photos(spark, d)
    entries = photos.filter("id % 7 = 0").select("path", F.lit(True).alias("favorite"), (F.col("id") % 2 == 0).alias("hidden"))
    return mutations.import_curation(photos, entries)[0].select("id", "favorite", "hidden")


@query("SELECT id, CASE WHEN id % 9 = 0 AND thumb_status = 1 THEN 0 ELSE thumb_status END AS thumb_status, CASE WHEN id % 9 = 0 THEN 0 ELSE faces_scanned END AS faces_scanned, CASE WHEN id % 9 = 0 THEN NULL ELSE content_hash END AS content_hash FROM photos")
def rearm_photos(spark, d):
    photos = X.photos(spark, d)
    return mutations.rearm(photos, X.faces(spark, d), photos.filter("id % 9 = 0").select("id"))[0].select("id", "thumb_status", "faces_scanned", "content_hash")


@query("SELECT id FROM faces WHERE photo_id % 9 <> 0")
def rearm_faces(spark, d):
    photos = X.photos(spark, d)
    return mutations.rearm(photos, X.faces(spark, d), photos.filter("id % 9 = 0").select("id"))[1].select("id")


@query("SELECT DISTINCT least(id, id * 3 % 40) AS a, greatest(id, id * 3 % 40) AS b FROM crowd EXCEPT SELECT a, b FROM apart")
def new_exemptions(spark, d):
    asked = X.named(spark, d).select(F.col("id").alias("a"), (F.col("id") * 3 % 40).alias("b"))
    return mutations.new_pairs(X.apart(spark, d), asked)


# ---- scan and change capture ----


@query("SELECT id FROM photos WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg','jpeg','png','webp','heic','heif') AND NOT regexp_matches(path, '(^|/)\\.')")
def scannable_files(spark, d):
    return ingest.scannable(X.photos(spark, d)).select("id")


@query("SELECT id FROM photos WHERE regexp_matches(lower(path), '\\.hei[cf]$')")
def heic_photos(spark, d):
    return X.photos(spark, d).filter(S.is_heic(F.col("path"))).select("id")


LE = " || ".join(f"substr(lpad(hex({{0}}), 16, '0'), {15 - 2 * i}, 2)" for i in range(8))


@query(f"SELECT id, sha256(unhex(hex(encode(path)) || '7C' || {LE.format('mtime')} || '7C' || {LE.format('size')})) AS version FROM photos")
def version_keys(spark, d):
    return X.photos(spark, d).select("id", S.version_key(F.col("path"), F.col("mtime"), F.col("size")).alias("version"))


SCAN = """WITH old AS (SELECT path, mtime + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS mtime, size, thumb_status FROM photos WHERE id % 11 <> 0)
SELECT p.path, CASE WHEN o.path IS NULL THEN 'new' WHEN o.mtime = p.mtime AND o.size = p.size AND o.thumb_status = 1 THEN 'unchanged' WHEN o.mtime = p.mtime AND o.size = p.size THEN 'again' ELSE 'changed' END AS change FROM photos p LEFT JOIN old o ON o.path = p.path WHERE p.id % 17 <> 0"""


def _snapshots(spark, d):
    photos = X.photos(spark, d)
    old = photos.filter("id % 11 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("id") % 13 == 0, 1).otherwise(0))
    return old, photos.filter("id % 17 <> 0").select("path", "mtime", "size")


@query(SCAN)
def rescan_classify(spark, d):
    return ingest.classify(*_snapshots(spark, d)).filter("change <> 'gone'").select("path", "change")


@query("SELECT id FROM photos WHERE id % 11 <> 0 AND id % 17 = 0")
def unseen_prune(spark, d):
    return ingest.unseen(*_snapshots(spark, d), roots_seen=True).select("id")


@query("""WITH roots AS (SELECT DISTINCT '/lib/' || split_part(path, '/', 3) AS path FROM photos UNION SELECT '/lib/src1/Beach'), left_ AS (SELECT path FROM roots WHERE path <> '/lib/src1')
SELECT id FROM photos p WHERE (p.path = '/lib/src1' OR starts_with(p.path, '/lib/src1/')) AND NOT EXISTS (SELECT 1 FROM left_ r WHERE p.path = r.path OR starts_with(p.path, r.path || '/'))""")
def root_removal(spark, d):
    photos = X.photos(spark, d)
    return ingest.removed_with_root(photos, X.roots(photos), "/lib/src1").select("id")


@query("""WITH gaps AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS first_ts, epoch_us(max(ts)) // 1000000 AS last_ts, count(*) AS n FROM runs GROUP BY user_id, s""")
def burst_sessions(spark, d):
    events = X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.bursts(events, "user_id", "30 minutes").select("user_id", F.unix_seconds("first_ts").alias("first_ts"), F.unix_seconds("last_ts").alias("last_ts"), "n")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def progress_tumbling(spark, d):
    events = X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.tumbling(events, "1 hour").select("event_type", F.unix_seconds("window.start").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query("""WITH firsts AS (SELECT user_id AS id, min(event_id) AS place FROM events GROUP BY 1) SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN id % 10 = 0 THEN 0 ELSE 1 END, place) AS INTEGER) AS turn FROM firsts ORDER BY turn LIMIT 100""")
def queue_order(spark, d):
    jobs = X.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("place"))
    return ingest.queue_order(jobs, jobs.filter("id % 10 = 0").select("id").distinct(), 100)


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stage_profile(spark, d):
    rows = X.table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return ingest.profile(rows).select("stage", "n", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"))


@query("SELECT CAST(id // 1000 AS BIGINT) AS bucket, count(*) AS n FROM photos GROUP BY 1")
def cache_buckets(spark, d):
    return X.photos(spark, d).groupBy(S.path_bucket(F.col("id")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# ---- scalars over small tables of cases ----

DUCK_DATE = r"(?:^|[^0-9])(199[0-9]|20[0-2][0-9]|203[0-5])[-_. T:/]?(0[1-9]|1[0-2])[-_. T:/]?(0[1-9]|[12][0-9]|3[01])(?:[-_. T:/]?([0-9]{2})[-_. T:/]?([0-9]{2})(?:[-_. T:/]?([0-9]{2}))?)?"
#: File names with an order's date in several styles, some without one, and times beyond the clock.
FILES = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('PXL_', {day}, '_', lpad(CAST(o_orderkey % 259999 AS {S}), 6, '0'), '123.jpg') WHEN 1 THEN concat('IMG_', {day}, '.jpg') WHEN 2 THEN concat({dashed}, ' 12.30.00.jpg')
 WHEN 3 THEN concat('DSC_', CAST(o_orderkey AS {S}), '.jpg') WHEN 4 THEN concat('1', {day}, '.jpg') ELSE concat('a', {day}, 'T', lpad(CAST(o_orderkey * 7919 % 1000000 AS {S}), 6, '0')) END AS name FROM {orders}"""
DUCK_DAYS = {"day": "strftime(o_orderdate, '%Y%m%d')", "dashed": "strftime(o_orderdate, '%Y-%m-%d')", "S": "VARCHAR", "orders": "orders"}
SPARK_DAYS = {"day": "date_format(o_orderdate, 'yyyyMMdd')", "dashed": "date_format(o_orderdate, 'yyyy-MM-dd')", "S": "STRING"}


@query(f"""WITH names AS ({FILES.format(**DUCK_DAYS)}), parts AS (SELECT id, {', '.join(f"try_cast(regexp_extract(name, '{DUCK_DATE}', {i}) AS BIGINT) AS p{i}" for i in range(1, 7))} FROM names)
SELECT id, CASE WHEN p1 IS NOT NULL THEN epoch_us(make_timestamp(p1, p2, 1, 0, 0, 0)) // 1000000 + (p3 - 1) * 86400 + CASE WHEN p4 <= 23 AND p5 <= 59 AND coalesce(p6, 0) <= 59 THEN p4 * 3600 + p5 * 60 + coalesce(p6, 0) ELSE 0 END END AS ts FROM parts""")
def filename_dates(spark, d):
    names = spark.sql(FILES.format(**SPARK_DAYS, orders="{orders}"), orders=X.table(spark, d, "orders"))
    return names.select("id", S.filename_date(F.col("name")).alias("ts"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400 WHEN 1 THEN epoch_us(o_orderdate) // 1000000 WHEN 2 THEN epoch_us(date_trunc('month', o_orderdate)) // 1000000 + 30 * 86400 END AS ts FROM orders")
def exif_dates(spark, d):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    clock = F.date_format(F.timestamp_seconds(key % 86400), "HH:mm:ss")
    text = F.when(key % 4 == 0, F.concat(F.date_format(day, "yyyy:MM:dd "), clock)).when(key % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(key % 4 == 2, F.date_format(day, "yyyy:MM:31 00:00:00")).otherwise(F.date_format(day, "yyyy:13:dd"))
    return X.table(spark, d, "orders").select(key.alias("id"), S.exif_datetime(text).alias("ts"))


@query("SELECT id, round(lat_ + m / 60.0 + s / 3600.0, 6) * CASE WHEN ref = 'S' THEN -1 ELSE 1 END + 0.0 AS degrees FROM (SELECT id, CAST(id % 90 AS DOUBLE) AS lat_, CAST(id % 60 AS DOUBLE) AS m, CAST(id % 59 AS DOUBLE) AS s, CASE WHEN id % 2 = 0 THEN 'S' ELSE 'N' END AS ref FROM photos)")
def dms_to_decimal(spark, d):
    part = lambda n: (F.col("id") % n).cast("double")
    ref = F.when(F.col("id") % 2 == 0, "s").otherwise("N")
    return X.photos(spark, d).select("id", F.round(S.dms_degrees(part(90), part(60), part(59), ref), 6).alias("degrees"))


@query("SELECT id, CASE WHEN n >= 1000000000 THEN printf('%.1f GB', n / 1e9) WHEN n >= 1000000 THEN printf('%.1f MB', n / 1e6) WHEN n >= 1000 THEN CAST(CAST(floor(n / 1e3 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' ELSE CAST(n AS VARCHAR) || ' B' END AS label FROM (SELECT id, size * size * 3 AS n FROM photos)")
def format_bytes(spark, d):
    return X.photos(spark, d).select("id", S.human_bytes(F.col("size") * F.col("size") * 3).alias("label"))


SHORT = "CASE WHEN abs({0} - floor({0} + 0.5)) < 0.05 THEN CAST(CAST(floor({0} + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {0}) END"


@query(f"""WITH shots AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 16 AS f, 1e0 / (1 + p_partkey % 250) * CASE WHEN p_partkey % 5 = 0 THEN 300 ELSE 1 END AS t, CAST(p_partkey % 240 AS DOUBLE) / 4 AS mm,
 CASE WHEN p_partkey % 11 > 0 THEN left(p_brand, 5) END AS make, CASE WHEN p_partkey % 13 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_name END END AS model FROM part)
SELECT id, CASE WHEN t < 1 THEN '1/' || CAST(CAST(floor(1 / t + 0.5) AS BIGINT) AS VARCHAR) || 's' ELSE {SHORT.format('t')} || 's' END AS exposure, 'ƒ/' || {SHORT.format('f')} AS f_number, 'ISO ' || id AS iso, {SHORT.format('mm')} || 'mm' AS focal,
 CASE WHEN make IS NULL THEN model WHEN model IS NULL THEN make WHEN contains(lower(model), lower(make)) THEN model ELSE make || ' ' || model END AS camera FROM shots""")
def exposure_label(spark, d):
    key, col = F.col("p_partkey"), F.col
    make = F.when(key % 11 > 0, F.left(F.col("p_brand"), F.lit(5)))
    model = F.when(key % 13 > 0, F.when(key % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_name")))
    shots = X.table(spark, d, "part").select(key.alias("id"), (F.col("p_size").cast("double") / 16).alias("f"), (F.lit(1.0) / (1 + key % 250) * F.when(key % 5 == 0, 300).otherwise(1)).alias("t"), ((key % 240).cast("double") / 4).alias("mm"), make.alias("make"), model.alias("model"))
    return shots.select("id", S.exposure_label(col("t")).alias("exposure"), S.f_number_label(col("f")).alias("f_number"), S.iso_label(col("id")).alias("iso"), S.focal_label(col("mm")).alias("focal"), S.camera_label(col("make"), col("model")).alias("camera"))


@query("SELECT n, CASE WHEN n > 999 THEN CAST(CAST(floor(n / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'k' ELSE CAST(n AS VARCHAR) END AS badge FROM (SELECT DISTINCT size AS n FROM photos)")
def count_badges(spark, d):
    return X.photos(spark, d).select(F.col("size").alias("n")).distinct().select("n", S.count_badge(F.col("n")).alias("badge"))


@query("SELECT event_id AS id, CASE WHEN hour(ts) < 12 THEN 'Good morning' WHEN hour(ts) < 18 THEN 'Good afternoon' ELSE 'Good evening' END AS greeting FROM events")
def greetings(spark, d):
    return X.table(spark, d, "events").select(F.col("event_id").alias("id"), S.greeting(F.hour("ts")).alias("greeting"))


@query("SELECT id, mtime AS ts FROM photos")
def exif_dates_of_photos(spark, d):
    text = F.date_format(S.when_of(F.col("mtime")), "yyyy:MM:dd HH:mm:ss")
    return X.photos(spark, d).select("id", S.exif_datetime(text).alias("ts"))


@query("SELECT id, '1/' || (id % 900 + 2) || 's' AS exposure, 'ISO ' || (id % 6400 + 50) AS iso, (id % 300 + 10) || 'mm' AS focal, 'ƒ/' || (id % 20 + 1) || '.5' AS f_number FROM photos")
def exposure_labels_of_photos(spark, d):
    i = F.col("id")
    return X.photos(spark, d).select("id", S.exposure_label(1.0 / (i % 900 + 2)).alias("exposure"), S.iso_label(i % 6400 + 50).alias("iso"), S.focal_label((i % 300 + 10).cast("double")).alias("focal"), S.f_number_label(i % 20 + 1.5).alias("f_number"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)



"""Search by the trigram index against the plain search, and what it saves."""

import random

import pytest

from heliograph.operators import library, postings

WORDS = ["Iceland", "Ángel", "fiesta", "June", "naïve", "100%_off", "한글", "Straße", "beach", "ab", "İstanbul", "📷📷📷 trip"]
QUERIES = ["iceland", "ANGEL fiesta", "june", "jun 2012", "mia", "mia 2012", "100%_off", "ma", "한글", "ß", "", None, "zzz", "/lib/", "ab", "e", "istanbul beach", "📷📷📷", "📷 tri", "2012", "+2012"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    path = lambda: "/lib/" + "/".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) + f"/{rng.randrange(10**6)}.jpg"
    rows = [(i, path(), 1325376000 + rng.randrange(-5, 5) * 86400 * 40) for i in range(400)]
    rows += [(400, None, 1338508800), (401, "", 1338508800), (402, "ab", 1338508800), (403, "/lib/" + "iceland " * 3000, 1338508800)]
    photos = spark.createDataFrame([(*r, None) for r in rows], "id long, path string, mtime long, taken_ts long")
    faces = spark.createDataFrame([(i, i * 9, 1 + i % 3, i % 5 == 0) for i in range(40)], "id long, photo_id long, identity_id long, off boolean")
    faces = faces.selectExpr("id", "photo_id", "identity_id", "cast(off as int) as ignored")
    return photos, faces, spark.createDataFrame([(1, "Mía"), (2, "Omar June"), (3, None)], "id long, name string")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_the_index_finds_what_the_search_finds(tables):
    photos, faces, people = tables
    index = postings.build(photos, per_part=1500)
    assert index.segments[0].parts.count() > 5
    for text in QUERIES:
        assert ids(postings.search(index, photos, text, faces, people)) == ids(library.search(photos, text, faces, people)), text


def test_new_renamed_and_removed_photos(tables):
    photos, faces, people = tables
    old = photos.filter("id % 3 > 0")
    now = photos.filter("id % 7 > 0").selectExpr("id", "case when id % 5 = 0 then concat('/lib/moved/beach/', id) else path end as path", "mtime", "taken_ts")
    index = postings.extend(postings.build(old, per_part=2000), now.filter("id % 3 = 0 or id % 5 = 0"))
    for text in ("moved", "beach", "iceland", "fiesta 2012", "june"):
        assert ids(postings.search(index, now, text, faces, people)) == ids(library.search(now, text, faces, people)), text


def test_few_paths_are_folded_and_few_parts_are_read(tables):
    photos, *_ = tables
    index = postings.build(photos, per_part=1000)
    total, every = index.segments[0].parts.count(), photos.count()
    for text in ("iceland", "naive", "fiesta"):
        found, may = ids(postings.on_path(photos, index, text)), postings.candidates(index, text).count()
        assert len(found) <= may < every / 2
    read = {f.rsplit("/", 2)[1] for f in postings.postings(index, ["ice"]).inputFiles()}
    assert len(read) <= 2 < total
    assert postings.candidates(index, "zzz").count() == 0
    assert postings.candidates(index, "ab") is None


def test_an_empty_library(spark, tables):
    photos, faces, people = tables
    none = photos.filter("false")
    index = postings.build(none)
    assert ids(postings.search(index, none, "iceland", faces, people)) == []

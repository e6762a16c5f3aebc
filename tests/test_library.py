"""Views, search, duplicates, roots and scalars on small tables."""

import pytest
from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.operators import ingest, library, mutations
from heliograph.sources import files

PHOTO = "id long, path string, mtime long, size long, thumb_status int, taken_ts long, seen long, faces_scanned int, lat double, lon double, favorite int, hidden int, content_hash string"


def photos(spark, *rows):
    base = {"mtime": 0, "size": 0, "thumb_status": 1, "taken_ts": None, "seen": 0, "faces_scanned": 1, "lat": None, "lon": None, "favorite": 0, "hidden": 0, "content_hash": None}
    names = [c.split()[0] for c in PHOTO.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], PHOTO)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_three_views_stats_and_curation(spark, tmp_path):
    p = photos(spark, {"id": 1, "path": "/a.jpg", "favorite": 1}, {"id": 2, "path": "/b.jpg", "hidden": 1}, {"id": 3, "path": "/c.jpg"})
    for tag, want in (("visible", [1, 3]), ("favorites", [1]), ("hidden", [2]), ("?", [1, 3])):
        assert sorted(ids(p.filter(library.curation(tag)))) == want
    assert tuple(library.stats(p).first()) == (3, 3, 1, 1)
    document = tmp_path / "curation.json"
    document.write_text(files.curation_document(mutations.curation_rows(p)).first()["value"])
    entries = files.read_curation(spark, str(document))
    assert entries.count() == 2
    fresh = photos(spark, {"id": 9, "path": "/a.jpg"}, {"id": 8, "path": "/b.jpg", "favorite": 1})
    merged, matched = mutations.import_curation(fresh, entries)
    assert matched.first()["matched"] == 2
    assert {(r["id"], r["favorite"], r["hidden"]) for r in merged.collect()} == {(9, 1, 0), (8, 1, 1)}


def test_root_removal_minds_components(spark):
    p = photos(spark, {"id": 1, "path": "/photos/a_b/loose.jpg"}, {"id": 2, "path": "/photos/a_b/keep/owned.jpg"}, {"id": 3, "path": "/photos/acb/sibling.jpg"})
    roots = spark.createDataFrame([("/photos/a_b",), ("/photos/a_b/keep",), ("/photos/acb",)], "path string")
    assert ids(ingest.removed_with_root(p, roots, "/photos/a_b")) == [1]


def test_stale_job_changes_nothing(spark):
    p = photos(spark, {"id": 1, "path": "/new.jpg", "thumb_status": 0}).withColumn("cache_key", F.lit("new-key"))
    job = lambda path, key: spark.createDataFrame([(1, path, key, 1)], "id long, path string, cache_key string, status int")
    assert mutations.publish_if_current(p, job("/old.jpg", "old-key")).first()["thumb_status"] == 0
    assert mutations.publish_if_current(p, job("/new.jpg", "new-key")).first()["thumb_status"] == 1


def test_search(spark):
    p = photos(
        spark, {"id": 1, "path": "/lib/Iceland trip/IMG_1.jpg", "taken_ts": 1559347200}, {"id": 2, "path": "/lib/Beach/IMG_2.jpg", "taken_ts": 1590969600},
        {"id": 3, "path": "/lib/Beach/IMG_100%_off.jpg"}, {"id": 4, "path": "/lib/Ángel fiesta/IMG_4.jpg"},
    )
    people = spark.createDataFrame([(1, "Mía")], "id long, name string")
    faces = spark.createDataFrame([(1, 2, 1, 0)], "id long, photo_id long, identity_id long, ignored int")
    find = lambda q: sorted(ids(library.search(p, q, faces, people)))
    want = {"iceland": [1], "2019": [1], "june": [1, 2], "jun 2020": [2], "beach 2019": [], "100%_off": [3], "mia": [2], "Mía": [2], "mia 2020": [2], "angel": [4], "ma": [], "": [1, 2, 3, 4]}
    for q, found in want.items():
        assert find(q) == found, q
    assert library.normalized_search("  ") is None and library.normalized_search(" a ") == "a"


def test_duplicates(spark):
    row = lambda i, h, size, hidden=0: {"id": i, "path": f"/{i}.jpg", "size": size, "content_hash": h, "hidden": hidden}
    p = photos(spark, *[row(i, "aaa", 100) for i in (1, 2, 3)], *[row(i, "bbb", 900) for i in (4, 5)], row(6, "ccc", 100), row(7, "ccc", 100, 1), row(8, "", 1), row(9, "", 1), row(10, None, 1))
    groups = library.duplicate_groups(p).collect()
    assert [(g["wasted_bytes"], [c["id"] for c in g["copies"]]) for g in groups] == [(900, [4, 5]), (200, [1, 2, 3])]
    assert ids(library.worklist(p, "hash", 100)) == [10]


def test_fold(spark):
    cases = {"Mía": "mia", "ÁNGEL": "angel", "Niño": "nino", "plain": "plain", None: None}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", S.fold(F.col("s")).alias("a"), S.fold_exact("s").alias("b")).collect()
    assert {r["s"]: r["a"] for r in got} == cases == {r["s"]: r["b"] for r in got}
    S.register(spark)
    assert spark.sql("select fold('Ñandú')").first()[0] == "nandu"


def test_filename_dates(spark):
    cases = {"PXL_20240614_155210823.jpg": 1718380330, "IMG_20230101.jpg": 1672531200, "2024-06-14 12.30.00.jpg": 1718368200, "VID_2022_12_25.mp4": 1671926400, "DSC_0042.jpg": None, "99999999.jpg": None}
    got = spark.createDataFrame([(n,) for n in cases], "n string").select("n", S.filename_date(F.col("n")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in got} == cases


def test_vector_blobs(spark):
    df = spark.createDataFrame([([1.0, -0.5],), (None,)], "v array<float>")
    got = df.select(S.encode_vector("v").alias("b")).select("b", S.decode_vector("b").alias("v")).collect()
    assert list(got[0]["v"]) == [1.0, -0.5] and bytes(got[0]["b"]) == b"\0\0\x80?\0\0\0\xbf" and got[1]["v"] is None


def test_scan_classify_and_upsert(spark, tmp_path):
    for name in ("a.jpg", "b.PNG", "c.txt", ".hidden/d.jpg"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"\xff\xd8" + name.encode())
    found = ingest.scan(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.jpg", "b.PNG"]
    assert ingest.hashes(spark, str(tmp_path)).count() == 3
    at = {r["path"].rsplit("/", 1)[1]: r for r in found.collect()}
    a = at["a.jpg"]
    known = photos(spark, {"id": 1, "path": a["path"], "mtime": a["mtime"], "size": a["size"], "content_hash": "h"}, {"id": 2, "path": "/gone.jpg"})
    assert {r["path"].rsplit("/", 1)[1]: r["change"] for r in ingest.classify(known, found).collect()} == {"a.jpg": "unchanged", "b.PNG": "new", "gone.jpg": "gone"}
    after = {r["path"].rsplit("/", 1)[1]: r for r in ingest.upsert(known, found, 7, 3).collect()}
    assert (after["a.jpg"]["seen"], after["a.jpg"]["content_hash"]) == (7, "h") and after["b.PNG"]["id"] == 3 and after["gone.jpg"]["seen"] == 0
    assert ids(ingest.unseen(known, found, True)) == [2] and ids(ingest.unseen(known, found, False)) == []
    changed = known.withColumn("mtime", F.col("mtime") - 5)
    assert {r["id"]: (r["thumb_status"], r["content_hash"]) for r in ingest.upsert(changed, found, 7, 3).collect()}[1] == (0, None)


def test_generation_only_grows():
    assert ingest.next_generation(10**15) == 10**15 + 1 and ingest.next_generation(0) > 10**12


def test_exif(spark):
    import struct

    def entry(tag, kind, n, value):
        return struct.pack("<HHI", tag, kind, n) + value

    taken = b"2024:06:14 12:30:05\0"
    dms = lambda *v: b"".join(struct.pack("<II", x, 1) for x in v)
    # header 8, first directory at 8 (2 entries), exif at 40, gps at 70; data from 150 on
    first = struct.pack("<H", 2) + entry(0x8769, 4, 1, struct.pack("<I", 40)) + entry(0x8825, 4, 1, struct.pack("<I", 70)) + b"\0" * 4
    exif = struct.pack("<H", 1) + entry(0x9003, 2, len(taken), struct.pack("<I", 150)) + b"\0" * 4
    gps = struct.pack("<H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, struct.pack("<I", 180)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, struct.pack("<I", 210)) + b"\0" * 4
    tiff = bytearray(b"II*\0" + struct.pack("<I", 8) + first).ljust(240, b"\0")
    tiff[40 : 40 + len(exif)], tiff[70 : 70 + len(gps)], tiff[150 : 150 + len(taken)] = exif, gps, taken
    tiff[180:204], tiff[210:234] = dms(33, 30, 0), dms(151, 0, 36)
    body = b"Exif\0\0" + bytes(tiff)
    jpeg = b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xd9"
    got = {r["path"]: r for r in ingest.positions(spark.createDataFrame([("a", jpeg), ("b", b"junk"), ("c", None)], "path string, content binary")).collect()}
    assert got["a"]["taken_ts"] == 1718368205 and got["a"]["lat"] == pytest.approx(-33.5) and got["a"]["lon"] == pytest.approx(151.01)
    assert got["b"]["taken_ts"] is None and got["c"]["lat"] is None


def test_defaults_are_added_once(spark):
    df = spark.createDataFrame([(1, 5)], "id int, size long")
    out = files.with_defaults(df, {"size": ("long", 0), "hidden": ("int", 0)})
    assert tuple(out.first()) == (1, 5, 0)
    assert [r["value"] for r in mutations.latest_by_key(spark.createDataFrame([("a", "1")], "key string, value string"), spark.createDataFrame([("a", "2")], "key string, value string")).collect()] == ["2"]


def test_fold_of_every_character(spark):
    """The native fold against the exact one, for every assigned character of the basic plane and some beyond."""
    import unicodedata

    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)] if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = [f"x{c}y" for c in chars] + ["Nguyễn Thị Ánh", "ΆΝΘΡΩΠΟΣ Ёлка й", "한국어 각", "e\u0301\u0327", "İstanbul"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.fold(F.col("t")).alias("f")).collect()
    wrong = [texts[r["i"]] for r in got if r["f"] != S.fold_literal(texts[r["i"]])]
    assert not wrong, [hex(ord(w[1])) for w in wrong][:20]


def test_search_in_other_scripts(spark):
    photos = spark.createDataFrame([(1, "/lib/Nguyễn/Ёлка.jpg"), (2, "/lib/Άνθρωπος/각.jpg"), (3, "/lib/plain.jpg")], "id long, path string").withColumns({"taken_ts": F.lit(None).cast("long"), "mtime": F.lit(0).cast("long")})
    faces = spark.createDataFrame([], "identity_id long, photo_id long, ignored int")
    people = spark.createDataFrame([], "id long, name string")
    found = lambda q: [r["id"] for r in library.search(photos, q, faces, people).select("id").collect()]
    assert found("nguyen елка") == [1] and found("ανθρωπος") == [2] and found("각") == [2] and found("zzz") == []


def test_exif_detail(spark):
    import struct

    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + value
    ratio = lambda a, b: struct.pack("<II", a, b)
    first = struct.pack("<H", 1) + entry(0x8769, 4, 1, struct.pack("<I", 40)) + b"\0" * 4
    shot = struct.pack("<H", 6) + entry(0x829A, 5, 1, struct.pack("<I", 150)) + entry(0x829D, 5, 1, struct.pack("<I", 158)) + entry(0x8827, 3, 1, struct.pack("<HH", 200, 0))
    shot += entry(0x920A, 5, 1, struct.pack("<I", 166)) + entry(0xA002, 4, 1, struct.pack("<I", 4000)) + entry(0xA003, 4, 1, struct.pack("<I", 3000)) + b"\0" * 4
    tiff = bytearray(b"II*\0" + struct.pack("<I", 8) + first).ljust(180, b"\0")
    tiff[40 : 40 + len(shot)], tiff[150:174] = shot, ratio(1, 250) + ratio(18, 10) + ratio(50, 1)
    body = b"Exif\0\0" + bytes(tiff)
    jpeg = b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xd9"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    plain = b"\xff\xd8\xff\xc0\0\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 9
    images = spark.createDataFrame([("a", 1, jpeg), ("b", 1, png), ("c", 1, plain), ("d", 3, jpeg), ("e", 1, None)], "path string, thumb_status int, content binary")
    got = {r["path"]: r for r in ingest.details(images).collect()}
    assert "d" not in got  # it is in the cloud
    assert [got["a"][k] for k in ("exposure", "f_number", "iso", "focal", "width", "height")] == ["1/250s", "ƒ/1.8", "ISO 200", "50mm", 4000, 3000]
    assert (got["b"]["width"], got["b"]["height"]) == (640, 480) and (got["c"]["width"], got["c"]["height"]) == (40, 30) and got["e"]["width"] is None


def test_late_results_and_drained_queue(spark):
    from heliograph.streaming import watch

    faces = "id long, photo_id long, cache_key string, embedding array<float>"
    known = spark.createDataFrame([], "id long, cluster_id long, photo_id long, embedding array<float>")
    batch = spark.createDataFrame([(1, 10, "new", [1.0, 0.0]), (2, 11, "old", [0.0, 1.0])], faces)
    versions = spark.createDataFrame([(10, "new"), (11, "newer")], "photo_id long, cache_key string")
    written, passes, queue = [], [], [True]
    step = watch.identities(lambda: known, lambda: versions, lambda df, n: written.extend(r["id"] for r in df.collect()))
    loose = lambda: versions.limit(len(written) if not passes else 0)
    run = watch.coordinator(step, lambda: versions if queue[0] else versions.limit(0), loose, lambda: passes.append(1))
    run(batch, 0)
    assert written == [1] and passes == []
    queue[0] = False
    run(batch.limit(0), 1)
    run(batch.limit(0), 2)
    assert passes == [1]


def test_a_batch_of_files_is_written_once(spark):
    from heliograph.streaming import watch

    kept = {"id": None, "times": 0}
    table = spark.createDataFrame([], "id long, path string, mtime long, size long, seen long, thumb_status int, faces_scanned int, content_hash string, taken_ts long, lat double, lon double, favorite int, hidden int")

    def write(df, batch_id):
        kept.update(id=batch_id, times=kept["times"] + 1)

    run = watch.upserts(lambda: table, lambda: kept["id"], write, lambda n: n + 1)
    batch = spark.createDataFrame([("/a.jpg", 1, 2)], "path string, mtime long, size long")
    for batch_id in (0, 0, 1, 1, 0):
        run(batch, batch_id)
    assert kept == {"id": 1, "times": 2}

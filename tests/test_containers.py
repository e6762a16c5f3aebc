"""EXIF blocks in every container that a scan accepts, and files that can't be read."""

import hashlib
import os
import struct
import zlib

import pytest

from heliograph.operators import ingest
from heliograph.sources import exif


def tiff(order="<", original=True, changed=True, gps=True):
    """A TIFF block: IFD0 (DateTime, Exif, GPS), Exif IFD (DateTimeOriginal, width, height), GPS IFD."""
    data, at = bytearray(), 400
    mark = {"<": b"II", ">": b"MM"}[order]

    def put(raw):
        nonlocal at
        data.extend(raw)
        at += len(raw)
        return at - len(raw)

    def ifd(entries):
        return struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in entries) + bytes(4)

    far = lambda raw: struct.pack(order + "I", put(raw))
    stamp = lambda s: (2, 20, far(s.encode() + b"\0"))
    degrees = lambda *v: (5, 3, far(b"".join(struct.pack(order + "II", x, 1) for x in v)))
    shot = ([(0x9003, *stamp("2021:03:04 05:06:07"))] if original else []) + [(0xA002, 4, 1, struct.pack(order + "I", 4032)), (0xA003, 4, 1, struct.pack(order + "I", 3024))]
    place = [(1, 2, 2, b"S\0\0\0"), (2, *degrees(10, 30, 0)), (3, 2, 2, b"E\0\0\0"), (4, *degrees(20, 15, 0))]
    first = ([(0x0132, *stamp("2022:01:01 00:00:00"))] if changed else []) + [(0x8769, 4, 1, struct.pack(order + "I", 100))] + ([(0x8825, 4, 1, struct.pack(order + "I", 200))] if gps else [])
    block = bytearray(400)
    block[:8] = mark + struct.pack(order + "HI", 42, 8)
    for start, part in ((8, ifd(first)), (100, ifd(shot)), (200, ifd(place))):
        block[start : start + len(part)] = part
    return bytes(block + data)


def jpeg(block):
    return b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda"


def png(block):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 40, 30) + bytes(5)) + chunk(b"tEXt", b"odd") + chunk(b"eXIf", block) + chunk(b"IEND", b"")


def webp(block, prefix=b""):
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = chunk(b"VP8X", bytes(4) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")) + chunk(b"ICCP", b"odd") + chunk(b"EXIF", prefix + block)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def heic(block, version=0, item=7, inside=False, wide=False):
    """A HEIF file whose Exif item lies in ``mdat`` in two extents, or in ``idat``."""
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    payload = struct.pack(">I", 6) + b"Exif\0\0" + block
    infe = lambda i, kind: box(b"infe", bytes([3 if wide else 2, 0, 0, 0]) + struct.pack(">I" if wide else ">H", i) + bytes(2) + kind + b"\0")
    iinf = box(b"iinf", bytes([1 if wide else 0, 0, 0, 0]) + struct.pack(">I" if wide else ">H", 2) + infe(1, b"hvc1") + infe(item, b"Exif"))
    num = lambda v: struct.pack(">I" if version == 2 else ">H", v)

    def iloc(at):
        def entry(i, extents):
            head = num(i) + (struct.pack(">H", 1 if inside and i == item else 0) if version else b"")
            return head + bytes(2) + struct.pack(">IH", 0, len(extents)) + b"".join(struct.pack(">II", *e) for e in extents)

        parts = [(at, 10), (at + 10, len(payload) - 10)]
        return box(b"iloc", bytes([version, 0, 0, 0]) + b"\x44\x40" + num(2) + entry(1, [(0, 0)]) + entry(item, parts))

    ftyp = box(b"ftyp", b"heic" + bytes(4) + b"mif1")
    meta = lambda at: box(b"meta", bytes(4) + box(b"hdlr", bytes(24)) + iinf + iloc(at) + (box(b"idat", payload) if inside else b""))
    if inside:
        return ftyp + meta(0)
    return ftyp + meta(len(ftyp) + len(meta(0)) + 8) + box(b"mdat", payload)


BUILT = {
    "jpeg": jpeg, "png": png, "webp": webp, "webp with prefix": lambda b: webp(b, b"Exif\0\0"), "heic": heic,
    "heic v1": lambda b: heic(b, 1), "heic v2": lambda b: heic(b, 2, 70000, wide=True), "heic idat": lambda b: heic(b, 1, inside=True),
}


@pytest.mark.parametrize("kind", BUILT)
@pytest.mark.parametrize("order", "<>")
def test_every_container(kind, order):
    found = exif.read(BUILT[kind](tiff(order)))
    assert (found["taken"], found["lat"], found["lon"], found["width"], found["height"]) == ("2021:03:04 05:06:07", -10.5, 20.25, 4032, 3024)
    assert exif.read(BUILT[kind](tiff(order, original=False)))["taken"] == "2022:01:01 00:00:00"
    bare = exif.read(BUILT[kind](tiff(order, False, False, False)))
    assert (bare["taken"], bare["lat"]) == (None, None)


def test_cut_and_odd_files_give_nothing():
    for kind, build in BUILT.items():
        whole = build(tiff())
        for end in range(0, len(whole), 7):
            exif.read(whole[:end])
    assert exif.read(webp(b""))["width"] == 640 and exif.read(png(b""))["height"] == 30
    lossless = b"RIFF" + bytes(4) + b"WEBPVP8L" + struct.pack("<I", 5) + b"\x2f" + (99 | 49 << 14).to_bytes(4, "little")
    assert exif.header_size(lossless) == (100, 50) and exif.header_size(b"RIFF") == (None, None)


def test_dates_and_places_of_all_kinds(spark):
    rows = spark.createDataFrame([(k, bytearray(b(tiff(original=k != "png")))) for k, b in BUILT.items()], "path string, content binary")
    got = {r["path"]: (r["taken_ts"], r["lat"], r["lon"]) for r in ingest.positions(rows).collect()}
    assert got == {k: (1640995200 if k == "png" else 1614834367, -10.5, 20.25) for k in BUILT}


def test_bad_files_and_folders_are_passed_over(spark, tmp_path, monkeypatch):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, content in (("a.jpg", b"a"), ("deep/b.png", b""), ("deep/er/c.heic", b"c" * 5000), ("deep/er/x.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling.jpg")
    os.symlink(tmp_path, tmp_path / "deep" / "loop")
    name = lambda p: p.removeprefix(f"{tmp_path}/")
    assert sorted(name(r["path"]) for r in ingest.scan(spark, str(tmp_path)).collect()) == ["a.jpg", "deep/b.png", "deep/er/c.heic"]
    assert ingest.scan(spark, str(tmp_path / "none")).count() == 0
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = spark.createDataFrame([(f"{tmp_path}/{p}",) for p in ("a.jpg", "dangling.jpg", "deep", "gone.png", "deep/er/c.heic")] + [("nosuch://x/y",)], "path string")
    got = {name(r["path"]): r["content_hash"] for r in ingest.digests(listed).collect()}
    assert got == {"a.jpg": sha(b"a"), "dangling.jpg": "", "deep": "", "gone.png": "", "deep/er/c.heic": sha(b"c" * 5000), "nosuch://x/y": ""}


def test_large_files_are_read_in_parts(tmp_path):
    import pyarrow as pa

    big = tmp_path / "big.jpg"
    with big.open("wb") as f:
        f.truncate(ingest.CHUNK * 40 + 3)
    (out,) = ingest._digests([pa.RecordBatch.from_arrays([pa.array([str(big)])], names=["path"])])
    assert out.column("content_hash").to_pylist() == [hashlib.sha256(bytes(ingest.CHUNK * 40 + 3)).hexdigest()]

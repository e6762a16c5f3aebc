"""A small EXIF reader: TIFF directories in JPEG, PNG, WebP and HEIF containers."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd

# EXIF tags, and bytes of the TIFF types.
MAKE, MODEL, CHANGED, EXIF_AT, GPS_AT, TAKEN = 0x010F, 0x0110, 0x0132, 0x8769, 0x8825, 0x9003
LENS, F_NUMBER, EXPOSURE, ISO, FOCAL, PIXELS_X, PIXELS_Y = 0xA434, 0x829D, 0x829A, 0x8827, 0x920A, 0xA002, 0xA003
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


# A PNG's first bytes, and what stands before an EXIF block in JPEG.
PNG, EXIF = b"\x89PNG\r\n\x1a\n", b"Exif\0\0"
FIELDS = ("taken", "lat", "lon", "make", "model", "lens", "f_number", "exposure", "iso", "focal", "width", "height")


def header_size(content: bytes) -> tuple[int | None, int | None]:
    """Width and height from a PNG's, WebP's or JPEG's header, without decoding."""
    if content[:8] == PNG and len(content) >= 24:
        return struct.unpack_from(">II", content, 16)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return _webp_size(content)
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # the frame's own segment
            return tuple(reversed(struct.unpack_from(">HH", content, at + 5)))
        at += 2 + size
    return None, None


def _webp_size(content: bytes) -> tuple[int | None, int | None]:
    for kind, start, end in _riff(content):
        body = content[start:end]
        if kind == b"VP8X" and len(body) >= 10:
            return 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
        if kind == b"VP8L" and len(body) >= 5:
            bits = int.from_bytes(body[1:5], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 " and len(body) >= 10:
            return tuple(v & 0x3FFF for v in struct.unpack_from("<HH", body, 6))
    return None, None


def _riff(content: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(kind, from, to) of a RIFF file's chunks, which are padded to even lengths."""
    at = 12
    while at + 8 <= len(content):
        size = int.from_bytes(content[at + 4 : at + 8], "little")
        yield content[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + size % 2


def _png(content: bytes) -> Iterator[tuple[bytes, int, int]]:
    at = len(PNG)
    while at + 8 <= len(content):
        size = int.from_bytes(content[at : at + 4], "big")
        yield content[at + 4 : at + 8], at + 8, at + 8 + size
        at += 12 + size


def _jpeg(content: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Segments up to the first scan."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        yield content[at + 1 : at + 2], at + 4, at + 2 + size
        at += 2 + size


def _boxes(content: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, from, to) of the boxes in a part of an ISO base media file."""
    while at + 8 <= end:
        size, head = int.from_bytes(content[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(content[at + 8 : at + 16], "big"), 16
        size = size or end - at  # 0: as far as it goes
        if size < head:
            return
        yield content[at + 4 : at + 8], at + head, min(at + size, end)
        at += size


class _Cursor:
    def __init__(self, content: bytes, at: int):
        self.content, self.at = content, at

    def take(self, size: int) -> int:
        if self.at + size > len(self.content):
            raise IndexError("beyond the end")
        self.at += size
        return int.from_bytes(self.content[self.at - size : self.at], "big")


def _heif(content: bytes) -> bytes | None:
    """The TIFF block of a HEIF file's Exif item: ``iinf`` names the item, ``iloc`` tells where it lies."""
    for kind, start, end in _boxes(content, 0, len(content)):
        if kind == b"meta":
            parts = {k: (a, b) for k, a, b in _boxes(content, start + 4, end)}
            item = _exif_item(content, *parts[b"iinf"])
            data = b"".join(content[a:b] for a, b in _extents(content, parts[b"iloc"][0], item, parts.get(b"idat", (0, 0))[0]))
            return data[4 + int.from_bytes(data[:4], "big") :]
    return None


def _exif_item(content: bytes, start: int, end: int) -> int:
    wide = content[start] > 0
    for kind, a, _ in _boxes(content, start + (8 if wide else 6), end):
        if kind == b"infe" and content[a] >= 2:
            at = _Cursor(content, a + 4)
            item = at.take(4 if content[a] > 2 else 2)
            at.take(2)
            if content[at.at : at.at + 4] == b"Exif":
                return item
    raise KeyError("no Exif item")


def _extents(content: bytes, start: int, wanted: int, idat: int) -> list[tuple[int, int]]:
    version, at = content[start], _Cursor(content, start + 4)
    sizes = at.take(2)
    offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15
    for _ in range(at.take(4 if version == 2 else 2)):
        item = at.take(4 if version == 2 else 2)
        method = at.take(2) & 15 if version else 0
        at.take(2)
        base = at.take(base_size) + (idat if method == 1 else 0)
        found = []
        for _ in range(at.take(2)):
            at.take(index_size if version else 0)
            offset, length = base + at.take(offset_size), at.take(length_size)
            found.append((offset, offset + length))
        if item == wanted:
            return found
    raise KeyError("the item lies nowhere")


def tiff_block(content: bytes) -> bytes | None:
    """The EXIF block of a photo of any kind that a scan accepts."""
    if content[:2] == b"\xff\xd8":
        return next((content[a + 6 : b] for kind, a, b in _jpeg(content) if kind == b"\xe1" and content[a : a + 6] == EXIF), None)
    if content[:8] == PNG:
        return next((content[a:b] for kind, a, b in _png(content) if kind == b"eXIf"), None)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return next((content[a:b].removeprefix(EXIF) for kind, a, b in _riff(content) if kind == b"EXIF"), None)
    return _heif(content) if content[4:8] == b"ftyp" else None


def directory(tiff: bytes, at: int, order: str) -> dict[int, object]:
    found = {}
    (count,) = struct.unpack_from(order + "H", tiff, at)
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)
        place = at + 10 + 12 * i
        if WIDTH.get(kind, 0) * n > 4:
            (place,) = struct.unpack_from(order + "I", tiff, place)
        if kind == 2:
            found[tag] = tiff[place : place + n].split(b"\0")[0].decode("latin-1").strip() or None
        elif kind in (3, 4):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, place)[0]
        elif kind == 5:
            parts = struct.unpack_from(f"{order}{2 * n}I", tiff, place)
            found[tag] = [a / b if b else float("nan") for a, b in zip(parts[::2], parts[1::2])]
    return found


def _degrees(parts, ref, negative: str):
    if not isinstance(parts, list) or not parts:
        return None
    value = sum(p / 60**i for i, p in enumerate(parts[:3]))
    return None if value != value else -value if str(ref or "").upper().startswith(negative) else value


def read(content: bytes | None) -> dict:
    """FIELDS of an image; whatever can't be read is None. Without EXIF dimensions the header's count."""
    out = dict.fromkeys(FIELDS) | dict(zip(("width", "height"), header_size(content or b"")))
    try:
        tiff = tiff_block(content or b"")
        if not tiff:
            return out
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        first = directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
        out |= {"make": first.get(MAKE), "model": first.get(MODEL), "taken": first.get(CHANGED)}
        if EXIF_AT in first:
            shot = directory(tiff, first[EXIF_AT], order)
            ratio = lambda tag: next((v for v in shot.get(tag) or [] if v == v), None) if isinstance(shot.get(tag), list) else None
            out |= {"taken": shot.get(TAKEN) or out["taken"], "lens": shot.get(LENS), "iso": shot.get(ISO), "f_number": ratio(F_NUMBER), "exposure": ratio(EXPOSURE), "focal": ratio(FOCAL)}
            if shot.get(PIXELS_X):
                out |= {"width": shot[PIXELS_X], "height": shot.get(PIXELS_Y)}
        if GPS_AT in first:
            gps = directory(tiff, first[GPS_AT], order)
            out |= {"lat": _degrees(gps.get(LAT), gps.get(LAT_REF), "S"), "lon": _degrees(gps.get(LON), gps.get(LON_REF), "W")}
    except (struct.error, KeyError, IndexError, ValueError):
        pass
    return out


def read_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([{"path": p} | read(c) for p, c in zip(batch["path"], batch["content"])], columns=["path", *FIELDS])

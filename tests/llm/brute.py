"""Plain Python versions that the queries are held against."""

import hashlib
import re
import zlib
from collections import defaultdict

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontaminate(docs, items):
    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def base_licenses(docs):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    out = []
    for doc_id, text in docs:
        w = words(text)
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        at = [i for i, _ in places]
        out.append((doc_id, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))))
    return out


def edited(docs):
    """Rows in order, each with its edited text's digest."""
    out = []
    for i, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        q = len(text) // 4
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()))
    return out


def pieces(docs, encode, capacity=4096):
    out = []
    for doc_id, text in docs:
        ids = [*encode(text or ""), 1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            out.append((doc_id, k, start, len(cut), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut))))
    return out


def shingles(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def components(sets, num=90, den=100):
    """{id: smallest id reachable} of {id: set}, every pair compared."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}

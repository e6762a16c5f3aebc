"""Substring dedup against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from heliograph.llm import suffix_dedup

SCHEMA = "doc_id long, text string, sha string, base long, n int"


def plain(rows, length):
    """Rows in order; a window that was seen before loses its bytes."""
    data = sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1]).hexdigest()))
    seen, out = set(), []
    for doc_id, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            window = b[i : i + length]
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA).repartition(3)


def made(rng, n, words):
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(8)]
    return [(rng.choice([i, i, i, None]), rng.choice([None, "", "short"]) if rng.random() < 0.1 else rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 6)))) for i in range(n)]


@pytest.mark.parametrize("length", [1, 2, 5, 8, 12, 20, 100])
def test_random_texts(spark, length):
    rng = random.Random(length)
    rows = made(rng, 40, ["é", "日本", "the", "and", "x", "yz", "longer", "word"])
    rows += [(100, "aaaaaaaaaaaaaaaaaaaaaaaaa" * 9), (101, "ab" * 150), (102, "aab" * 70)] + rows[:5] + [(3, "a second text of the id 3" * 6)]
    assert got(suffix_dedup.dedup_substrings(frame(spark, rows), length)) == plain(rows, length)


def test_small_buckets_and_chunks(spark, monkeypatch):
    """A gram on both sides of a border, and texts that are hashed in parts."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 2)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    rng = random.Random(11)
    middle = "a passage that stands in every document of this table and is not short"
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(30)) + middle + "".join(rng.choice("ab") for _ in range(30))) for i in range(60)]
    assert got(suffix_dedup.dedup_substrings(frame(spark, rows), 24)) == plain(rows, 24)


def test_no_rows(spark):
    assert got(suffix_dedup.dedup_substrings(frame(spark, []))) == []
    assert got(suffix_dedup.dedup_substrings(frame(spark, [(1, None), (None, ""), (2, "x" * 99)]))) == plain([(1, None), (None, ""), (2, "x" * 99)], 100)


def test_multikey_finds_all_ties():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(0, 2, 400).astype(np.uint8)] * 2 + [np.zeros(8, np.uint8)])
    for length in (3, 8, 11, 16):
        places = np.arange(800 - length)
        item, group = suffix_dedup.multikey(data, places, length)
        by = {}
        for p in places:
            by.setdefault(data[p : p + length].tobytes(), []).append(p)
        want = [v for _, v in sorted(by.items()) if len(v) > 1]
        assert [sorted(item[group == g]) for g in np.unique(group)] == want


def test_whole_table(spark, sf_dir):
    from heliograph.llm.queries import op12_suffix_dedup

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = got(op12_suffix_dedup(spark, sf_dir))
    assert found == plain(rows, 100) and any(0 < r[2] < r[1] for r in found)

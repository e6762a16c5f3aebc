"""Operators 4 and 7, and what they are made of, against every pair compared."""

import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from brute import components, shingles

from heliograph.llm import components as cc
from heliograph.llm import ngram_join, similar, substring_dedup

ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one  two\n"), (7, "a b c"), (8, "A B C"), (9, "É b c"), (10, "é b c"), (11, "x\x0by z"), (11, "x\x0by z")]


def near_copies(rng, n, words=60, copies=4):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, words))]
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return list(enumerate(out))


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, n string")


def test_partition_keys_miss_no_pair():
    rng = random.Random(1)
    universe = np.unique(np.array([rng.getrandbits(64) for _ in range(4000)], dtype=np.uint64))
    sets = []
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(3):
            base = np.sort(np.array(rng.sample(universe.tolist(), size), dtype=np.uint64))
            sets.append(base)
            for _ in range(4):
                own = set(base.tolist())
                for _ in range(rng.randrange(0, max(1, size // 18) + 1)):
                    if rng.random() < 0.5 and len(own) > 1:
                        own.discard(rng.choice(sorted(own)))
                    if rng.random() < 0.5:
                        own.add(rng.choice(universe.tolist()))
                sets.append(np.sort(np.array(sorted(own), dtype=np.uint64)))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    keys, owners = similar.partition_keys(np.concatenate(sets), bounds, 90, 100)
    by_text = {}
    for k, o in zip(keys.tolist(), owners.tolist()):
        by_text.setdefault(o, set()).add(k)
    pairs = 0
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                pairs += 1
                assert by_text[i] & by_text[j], (len(sets[i]), len(sets[j]), shared)
    assert pairs > 500


@pytest.mark.parametrize("sides", [False, True])
def test_trees_find_what_all_pairs_find(sides):
    rng = random.Random(2)
    docs = near_copies(rng, 150, 80, 6)
    values, bounds = similar.shingle_sets(pa.array([t for _, t in docs]), 3)
    sets = [values[a:b] for a, b in zip(bounds, bounds[1:])]
    side = [1 + i % 2 if sides else 0 for i in range(len(docs))]
    links = similar.link_unit(list(range(len(docs))), side, sets, 90, 100)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        shared = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared)
        parent[max(root(a), root(b))] = min(root(a), root(b))
    for i in range(len(docs)):
        for j in range(i + 1, len(docs)):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if (not sides or side[i] != side[j]) and 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                assert root(i) == root(j)


def check_join(spark, docs):
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(frame(spark, docs)).collect())
    sets = {d: shingles(t) for d, t in docs}
    label = components(sets)
    assert got == sorted((d, len(sets[d]), label[d]) for d, _ in docs)
    return label


def test_join_odd_rows(spark):
    check_join(spark, ODD)
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.jaccard_components(frame(spark, [(None, "a b c d")])).collect()] == [(None, 2, None)]


def test_join_near_copies(spark, monkeypatch):
    docs = near_copies(random.Random(4), 120)
    label = check_join(spark, docs)
    assert len(set(label.values())) < len(docs)
    kept = {r["doc_id"] for r in ngram_join.keep_one(frame(spark, docs)).collect()}
    assert kept == set(label.values())


def test_join_splits_large_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    docs = []
    for d in range(120):
        own = list(base)
        own[rng.randrange(90)] = f"x{rng.randrange(30)}"
        docs.append((d, " ".join(own[: 90 - rng.randrange(0, 3)])))
    monkeypatch.setattr(similar, "NODE_TEXTS", 16)
    check_join(spark, docs)


def test_large_block_of_near_texts(spark, monkeypatch):
    """Near copies of one text meet its first copy and what that leaves, not each other."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for d in range(400):
        own = list(base)
        for _ in range(min(d, rng.randrange(0, 4))):
            own[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        docs.append((d, " ".join(own)))
    monkeypatch.setattr(similar, "NODE_TEXTS", 32)
    rows, kept = [], similar._units
    monkeypatch.setattr(similar, "_units", lambda *a: rows.append((out := kept(*a)).count()) or out)
    check_join(spark, docs)
    assert rows[0] < 400 * 400 / 32 / 3


def test_join_generated_documents(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert len(set(check_join(spark, docs).values())) < len(docs)


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r["id"]: r["component"] for r in cc.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {i: root(i) for i in got} and set(got) >= {i for e in edges for i in e if e[0] != e[1]}
    assert cc.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_paragraphs(docs, min_words):
    para = {}
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            if t is not None and len([w for w in line.split(" ") if w]) >= min_words:
                para[(d, i)] = line
    label = components({k: shingles(v, 5) for k, v in para.items()}, 80)
    out = []
    for d, t in docs:
        own = [k for k in para if k[0] == d]
        gone = {i for k in own for i in [k[1]] if label[k] != k}
        text = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append((d, text, len(own), len(gone), sorted({label[k][0] for k in own if label[k] != k})))
    return sorted(out, key=lambda r: r[0])


def test_substring_dedup(spark):
    rng = random.Random(6)
    passages = [" ".join(f"p{rng.randrange(500)}" for _ in range(rng.randrange(8, 60))) for _ in range(20)]
    docs = []
    for d in range(50):
        lines = [" ".join(f"q{rng.randrange(5000)}" for _ in range(rng.randrange(1, 30))) for _ in range(3)]
        own = rng.choice(passages).split(" ")
        own[rng.randrange(len(own))] = "edit"
        docs.append((d, "\n".join([lines[0], " ".join(own), *lines[1:], rng.choice(passages)])))
    docs += [(90, None), (91, ""), (92, "\n\n"), (93, passages[0]), (94, passages[0] + "\n" + passages[0])]
    got = substring_dedup.dedup_paragraphs(frame(spark, docs), min_words=8).drop("n").collect()
    rows = sorted((tuple(r) for r in got), key=lambda r: r[0])
    want = brute_paragraphs(docs, 8)
    # Banding finds a pair with probability 0.998 or more; here every one is found.
    assert [(r[0], r[1], r[2], r[3], list(r[4])) for r in rows] == want
    assert substring_dedup.dedup_paragraphs(frame(spark, [])).count() == 0


def test_banding_recall():
    assert 1 - (1 - 0.8**substring_dedup.ROWS) ** substring_dedup.BANDS > 0.997
    values, bounds = similar.shingle_sets(pa.array(["a b c d e f g", "a b c d e f g", "", None]), 5)
    keys, owners = partial(similar.minhash_keys, bands=9, rows=3)(values, bounds)
    assert sorted(owners.tolist()) == [0] * 9 + [1] * 9 and len(set(keys.tolist())) == 9

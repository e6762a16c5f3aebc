"""Integer product codes against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from heliograph.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, of int"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((x - y) ** 2 for x, y in zip(cut(v, p), e)), n) for n, e in enumerate(book[p]))
    for _ in range(rounds):
        codes = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(book[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == e]
                if own:
                    book[p][e] = [sum(col) // len(own) for col in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    last = [[near(v, p) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(d for d, _ in row) for row in last]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{c:02x}" for _, c in row), e, by_label[label], sha) for (i, _, label), row, e in zip(kept, last, errors)]


def got(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_plain_python_on_odd_rows(spark):
    rng = random.Random(7)
    vector = lambda n=16: [float(np.float32(rng.gauss(0, 1))) for _ in range(n)]
    rows = [(i, vector(), rng.choice([None, 1, 2, 3])) for i in rng.sample(range(1000), 120)]
    rows += [(5000, None, 1), (5001, [1.0, None] * 8, 1), (5002, [float("nan")] * 16, 2), (5003, [float("inf")] * 16, None), (5004, [], 1), (5005, vector(24), 1), (5006, vector(15), 1)]
    rows += [rows[3], rows[3], (None, vector(), None), (7000, [0.0] * 16, 4), (7001, [-0.0001] * 16, 4), (7002, [-0.0001] * 16, 4)]
    for some in (rows, rows[:5], rows[120:125], [], [(i, [7e4 * (-1) ** i + i] * 16, 1) for i in range(20)]):
        df = spark.createDataFrame([(*r, "c", "e", 9) for r in some], SCHEMA).repartition(3)
        assert got(vector_codes.encode_vectors(df)) == sorted(plain(some), key=repr)


def test_sums_beyond_64_bits_end_the_job(spark):
    df = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 16, 1, "c", "e", 9) for i in range(20)], SCHEMA)
    with pytest.raises(Exception, match="too large|Overflow"):
        vector_codes.encode_vectors(df).collect()


def test_other_sizes(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(6)], i % 2) for i in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*r, "c", "e", 9) for r in rows], SCHEMA)
    assert got(vector_codes.encode_vectors(df, parts=2, entries=5, rounds=3)) == sorted(plain(rows, 2, 5, 3), key=repr)


def test_labels_joined_by_shuffle(spark, monkeypatch):
    from heliograph.llm import words

    monkeypatch.setattr(words, "BROADCAST_ROWS", 0)
    rows = [(i, [float(i % 7 - 3)] * 8, None if i % 3 else 1) for i in range(40)]
    df = spark.createDataFrame([(*r, "c", "e", 9) for r in rows], SCHEMA)
    assert got(vector_codes.encode_vectors(df)) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    from heliograph.llm.queries import op11_vector_codes

    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(op11_vector_codes(spark, f"/root/testdata/{sf}")) == sorted(plain(rows), key=repr)

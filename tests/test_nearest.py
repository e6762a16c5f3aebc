"""The best others of held vectors as batches stream past, against all pairs; what the search leaves to its readers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import vectors


def fold(x, y):
    total = 0.0
    for p, q in zip(x, y):
        total += float(p) * float(q)
    return total


def brute(ids, v, k, tau):
    out = []
    for a, x in zip(ids, v):
        others = sorted((-fold(x, y), b) for b, y in zip(ids, v) if a != b)[:k]
        out += [(a, b, -s, r + 1) for r, (s, b) in enumerate(others) if -s >= tau]
    return sorted(out)


@pytest.mark.parametrize("scale,tau", [(1.0, 0.2), (1.0, -1.0), (1e-3, 1e-7), (1e18, 1e35)])
def test_streamed_batches_equal_all_pairs(scale, tau):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(150, 32))
    v = (scale * v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")
    v[20:60] = v[3]  # many copies: ties by id
    ids = rng.permutation(5000)[:150]
    near = vectors.Nearest(ids[:70], v[:70], 5, tau)
    for at in range(0, 150, 33):
        near.see(ids[at : at + 33], v[at : at + 33])
    got = sorted(zip(*(x.tolist() for x in near.found())))
    assert got == [r for r in brute(ids.tolist(), v, 5, tau) if r[0] in set(ids[:70].tolist())]


def test_only_the_first_copies_are_kept():
    v = np.repeat(np.eye(3, dtype="float32"), [4, 1, 2], axis=0)
    assert vectors.foremost(v, np.array([9, 3, 5, 1, 8, 7, 6]), 2).tolist() == [1, 3, 4, 5, 6]


def test_units_of_bounded_size_and_one_search(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(130, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")
    faces = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    near = vectors.knn(faces, 3, 0.1, held=20)
    assert sorted(map(tuple, near.select("i", "j", "sim", "rank").collect())) == brute(range(130), v, 3, 0.1)
    plan = vectors.mutual_edges(near)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "InArrow" not in plan and "Pandas" not in plan
    back = {(r["i"], r["j"]) for r in near.collect()}
    assert {(r["a"], r["b"]) for r in vectors.mutual_edges(near).collect()} == {(i, j) for i, j in back if i < j and (j, i) in back}
    assert vectors.knn(faces.filter(F.col("id") < 0), 3, 0.1).count() == 0

"""Pruned neighbour search against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import vectors


def gathered(seed, n=240, dim=24, towns=8, noise=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(towns, dim))
    v = centres[rng.integers(0, towns, n)] / np.linalg.norm(centres, axis=1).mean() + noise * rng.normal(size=(n, dim)) / np.sqrt(dim)
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(float)
    v[5] = v[6] = v[7]
    return rng.permutation(1000)[:n].tolist(), v


def all_pairs(ids, v, k, tau):
    out = set()
    for a, x in zip(ids, v):
        sims = sorted(((-float(sum(p * q for p, q in zip(x, y))), b) for b, y in zip(ids, v) if a != b))
        out |= {(a, b, r + 1) for r, (s, b) in enumerate(sims[:k]) if -s >= tau}
    return out


@pytest.mark.parametrize("block,pivots,tau,noise", [(1000, 64, 0.5, 0.15), (20, 64, 0.6, 0.15), (20, 3, 0.3, 1.0), (20, 64, -1.0, 0.5)])
def test_equals_all_pairs(spark, block, pivots, tau, noise):
    ids, v = gathered(block + pivots, 120 if tau < 0 else 200, noise=noise)
    faces = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id long, embedding array<float>")
    got = {(r["i"], r["j"], r["rank"]) for r in vectors.knn(faces, 4, tau, block, pivots).select("i", "j", "rank").collect()}
    assert got == all_pairs(ids, v, 4, tau)


def test_far_blocks_are_not_called(spark):
    ids, v = gathered(1)
    faces = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id long, embedding array<float>")
    placed = vectors.visits(faces, 0.6, 15, 64)
    blocks, calls = placed.select("home").distinct().count(), placed.agg(F.sum(F.size("calls"))).first()[0]
    assert blocks > 8 and calls < 0.6 * blocks * len(ids)
    assert placed.filter(~F.array_contains("calls", F.col("home"))).count() == 0


def test_rows_that_reach_nothing_are_dropped():
    rng = np.random.default_rng(3)
    a, b = np.abs(rng.normal(size=(50, 32))), np.abs(rng.normal(size=(40, 32)))
    a[:, :16] *= 3
    b[20:, :16] = 0
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    r, c, sims = vectors.near_pairs(a, b, 0.8)
    assert len(c) < 40 and np.allclose(sims, (a @ b.T)[np.ix_(r, c)])
    left = np.ones((50, 40), bool)
    left[np.ix_(r, c)] = False
    assert (a @ b.T)[left].max() < 0.8

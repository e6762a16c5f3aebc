"""Constrained complete linkage in rounds against one serial pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import clusters, vectors
from heliograph.plans.params import Params


def serial(ids, mat, edges, tau, photo, person, name, apart, exempt):
    """Every edge in turn, strongest first, ties by its ends; the whole table at once."""
    at = {f: i for i, f in enumerate(ids)}
    group = {f: {f} for f in ids}

    def differ(f, g):
        p, q = person.get(f), person.get(g)
        people = p is not None and q is not None and ((min(p, q), max(p, q)) in apart or (name.get(p) and name.get(q) and name[p] != name[q]))
        photos = photo.get(f) is not None and photo.get(f) == photo.get(g) and (min(f, g), max(f, g)) not in exempt
        return people or photos or mat[at[f]] @ mat[at[g]] < tau

    for _, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if group[a] is not group[b] and not any(differ(f, g) for f in group[a] for g in group[b]):
            group[a] |= group[b]
            for f in group[b]:
                group[f] = group[a]
    return {f: min(g) for f, g in group.items()}


def made(spark, seed, n=48, dim=4):
    """Grid vectors, so that many similarities tie; a chain of people, photos and exemptions."""
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(500), n):
        v = [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(dim)]
        v[rng.randrange(dim)] += 3.0
        rows.append((i, v, rng.choice([None, rng.randrange(40)]), rng.choice([None, None, rng.randrange(6)])))
    name = {0: "A", 1: "B", 2: None, 3: "A", 4: None, 5: "C"}
    faces = spark.createDataFrame([(i, v) for i, v, _, _ in rows], "id long, embedding array<float>")
    ids = [r[0] for r in rows]
    exempt = {tuple(sorted(rng.sample(ids, 2))) for _ in range(300)}
    return rows, name, faces, {(1, 2), (2, 4), (0, 3)}, exempt


@pytest.mark.parametrize("seed,limit", [(1, 50_000), (2, 1), (3, 12)])
def test_rounds_equal_the_serial_pass(spark, seed, limit):
    rows, name, faces, apart, exempt = made(spark, seed, 48 if limit > 1 else 24)
    unit = faces.select("id", vectors.normalized(F.col("embedding")).alias("embedding")).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    p = Params(k=6, link=0.8)
    photo, person = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    photo_of = spark.createDataFrame([(i, p_) for i, p_ in photo.items() if p_ is not None], "id long, photo_id long")
    identity_of = spark.createDataFrame([(i, q, name[q]) for i, q in person.items() if q is not None], "id long, identity_id long, name string")
    pairs = lambda some: spark.createDataFrame(sorted(some), "a long, b long")
    got = {r["id"]: r["cluster"] for r in clusters.recluster(unit, p, photo_of, identity_of, pairs(apart), pairs(exempt), limit).collect()}
    held = {r["id"]: r["embedding"] for r in unit.collect()}
    ids = sorted(held)
    edges = [tuple(r) for r in vectors.candidate_edges(vectors.knn(unit, p.k, p.link)).select("sim", "a", "b").collect()]
    want = serial(ids, clusters.unit_rows(np.array([held[i] for i in ids])), edges, p.link, photo, person, name, apart, exempt)
    number = {g: k + 1 for k, g in enumerate(sorted(set(want.values())))}
    assert got == {i: number[g] for i, g in want.items()}
    assert 1 < len(number) < len(ids)


def test_a_group_waits_for_what_is_decided_elsewhere():
    mat = clusters.unit_rows(np.ones((4, 3)))
    blank = [None] * 4
    to, refused = clusters.link_block({1: [0], 2: [1], 3: [2]}, [(1, 9, False), (1, 2, True), (2, 3, True)], mat, 0.5, blank, blank, blank, [set()] * 4, [set()] * 4, [1, 2, 3, 4])
    assert to == {1: 1, 2: 2, 3: 3} and refused == []


def test_no_edges(spark):
    faces = spark.createDataFrame([(5, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    assert sorted(tuple(r) for r in clusters.recluster(faces).select("id", "cluster").collect()) == [(2, 1), (5, 2)]
    assert clusters.recluster(faces.limit(0)).count() == 0

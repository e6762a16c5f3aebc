"""Linkage of all faces by one task that they stream into, against one serial pass and against rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_linkage import made, serial

from heliograph.operators import clusters, vectors
from heliograph.plans.params import Params


@pytest.mark.parametrize("seed", [4, 5])
def test_whole_equals_the_serial_pass(spark, monkeypatch, seed):
    monkeypatch.setattr(clusters, "BLOCK_FACES", 5)  # more faces than a round's block holds
    monkeypatch.setattr(clusters, "_blocks", None)  # no rounds
    rows, name, faces, apart, exempt = made(spark, seed)
    unit = faces.select("id", vectors.normalized(F.col("embedding")).alias("embedding")).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    p = Params(k=6, link=0.8)
    photo, person = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    photo_of = spark.createDataFrame([(i, q) for i, q in photo.items() if q is not None], "id long, photo_id long")
    identity_of = spark.createDataFrame([(i, q, name[q]) for i, q in person.items() if q is not None], "id long, identity_id long, name string")
    pairs = lambda some: spark.createDataFrame(sorted(some), "a long, b long")
    got = {r["id"]: r["cluster"] for r in clusters.recluster(unit, p, photo_of, identity_of, pairs(apart), pairs(exempt)).collect()}
    held = {r["id"]: r["embedding"] for r in unit.collect()}
    ids = sorted(held)
    edges = [tuple(r) for r in vectors.candidate_edges(vectors.knn(unit, p.k, p.link)).select("sim", "a", "b").collect()]
    want = serial(ids, clusters.unit_rows(np.array([held[i] for i in ids])), edges, p.link, photo, person, name, apart, exempt)
    number = {g: k + 1 for k, g in enumerate(sorted(set(want.values())))}
    assert got == {i: number[g] for i, g in want.items()} and 1 < len(number) < len(ids)


def test_batches_make_no_difference():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 3, (30, 4)) + np.eye(4)[rng.integers(0, 4, 30)]
    ids = rng.permutation(900)[:30]
    a, b = np.array([(x, y) for x in ids for y in ids if x < y and rng.random() < 0.3]).T
    labels = []
    for step in (1000, 7):
        whole, blank = clusters.Whole(30, 4, 0.8), lambda n: [None] * n
        for at in range(0, 30, step):
            n = len(ids[at : at + step])
            whole.add(ids[at : at + step], v[at : at + step], [int(i) % 9 for i in ids[at : at + step]], blank(n), blank(n), [[]] * n, [[]] * n)
        whole.close()
        for at in range(0, len(a), step):
            whole.link(a[at : at + step], b[at : at + step])
        labels.append(dict(zip(*(x.tolist() for x in whole.labels()))))
    assert labels[0] == labels[1] and 1 < len(set(labels[0].values())) < 30

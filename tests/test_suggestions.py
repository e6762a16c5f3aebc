"""Kept suggestions after decisions against those made anew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import mutations, suggestions
from heliograph.plans.params import Params

FACE = "id long, photo_id long, score double, embedding array<float>, cluster_id long, identity_id long, ignored int, confirmed int"
LOOSE = Params(link=0.3, fold_margin=0.02, min_anchor=2, anchor_size=4, core_floor=3)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8))
    rows = []
    for i in range(240):
        c = i % 24
        v = middles[c % 12] + 0.7 * rng.normal(size=8)
        person = c + 1 if c < 6 and i % 3 else None
        rows.append((i, i // 2 if i % 16 < 3 else 1000 + i, float(rng.random()), [float(x) for x in v / np.linalg.norm(v)], c + 1, person, int(i % 29 == 0), int(person is not None and i % 4 > 0)))
    return spark.createDataFrame(rows, FACE), spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "D"), (5, "E"), (6, "F")], "id long, name string")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def decide(rng, faces, identities):
    some = sorted(rng.sample(range(240), 8))
    kind = rng.randrange(6)
    if kind == 0:
        return mutations.set_person(faces, some, rng.randrange(1, 7)), identities
    if kind == 1:
        return mutations.detach(faces, some), identities
    if kind == 2:
        return mutations.ignore(faces, some), identities
    if kind == 3:
        return faces, identities.withColumn("name", F.when(F.col("id") == rng.randrange(1, 7), F.lit(rng.choice(["Z", None]))).otherwise(F.col("name")))
    if kind == 4:
        return mutations.merge_group(faces, identities, rng.randrange(1, 4), -rng.randrange(4, 7))
    return faces.filter(~F.col("id").isin(some)), identities


@pytest.mark.parametrize("trim", [False, True])
def test_kept_claims_equal_those_made_anew(spark, world, tmp_path, trim):
    rng, (faces, identities) = random.Random(11 + trim), world
    kept = suggestions.full(faces, identities, f"file://{tmp_path}/kept", 0, LOOSE, trim)
    assert kept.claims.count() > 0
    for step in range(4):
        after, who = decide(rng, faces, identities)
        after, who = after.checkpoint(), who.checkpoint()
        kept = suggestions.refresh(kept, faces, after, who, LOOSE, trim)
        anew = suggestions.full(after, who, f"file://{tmp_path}/anew", step, LOOSE, trim)
        for table in ("core", "matches", "claims"):
            order = [c for c in suggestions.TABLES[table].replace(",", "").split() if c in anew.claims.columns or c in ("id", "size", "matched", "max_sim")] if table != "core" else ["identity_id", "id"]
            assert rows(getattr(kept, table).select(*order)) == rows(getattr(anew, table).select(*order)), (step, table)
        faces, identities = after, who


def test_only_what_was_touched_is_made_anew(spark, world, tmp_path):
    faces, identities = world
    after = mutations.detach(faces, [1])
    groups, people_ = suggestions.touched(faces, after)
    assert {r[0] for r in groups.collect()} == {-2, 2} and {r[0] for r in people_.collect()} == {2}
    assert suggestions.touched(faces, faces)[0].count() == 0


def test_an_unfinished_or_other_generation_serves_nothing(spark, world, tmp_path):
    faces, identities = world
    root = f"file://{tmp_path}/kept"
    kept = suggestions.full(faces, identities, root, 3, LOOSE, False)
    photos = spark.createDataFrame([(1, 1, 1)], "id long, thumb_status int, faces_scanned int")
    again = suggestions.load(spark, root, 3)
    assert rows(again.claims) == rows(kept.claims) == rows(suggestions.serve(again, photos, 3))
    assert suggestions.load(spark, root, 4) is None
    assert suggestions.serve(kept, photos, 4).count() == 0 and suggestions.serve(kept, photos, 3, running=True).count() == 0
    assert suggestions.serve(kept, photos.withColumn("faces_scanned", F.lit(0)), 3).count() == 0


def test_nobody_and_nothing(spark, world, tmp_path):
    faces, identities = world
    none = faces.filter("false")
    kept = suggestions.full(none, identities.filter("false"), f"file://{tmp_path}/kept", 0, LOOSE)
    assert kept.claims.count() == 0
    assert suggestions.refresh(kept, none, faces, identities, LOOSE).claims.count() == suggestions.full(faces, identities, f"file://{tmp_path}/anew", 0, LOOSE).claims.count() > 0

"""Groups, merges, undo, clustering and decisions on small tables."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliograph.operators import clusters, mutations, people, recognition, vectors
from heliograph.operators.mutations import Catalog, StaleVersion
from heliograph.plans.params import DEFAULT, Params

FACE = "id long, photo_id long, x1 double, y1 double, x2 double, y2 double, score double, embedding array<float>, cluster_id long, identity_id long, ignored int, confirmed int"


def faces(spark, *rows):
    """(id, photo, cluster, identity, confirmed[, vector])"""
    return spark.createDataFrame([(r[0], r[1], 0.0, 0.0, 1.0, 1.0, 0.9, [float(x) for x in (r[5] if len(r) > 5 else [1.0])], r[2], r[3], 0, r[4]) for r in rows], FACE)


def named(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, name string")


def links(spark, *rows):
    return spark.createDataFrame(list(rows), "a long, b long")


def catalog(spark, f, i):
    return Catalog(f, f, i, links(spark), links(spark))


def state(df):
    return {r["id"]: (r["identity_id"], r["confirmed"]) for r in df.collect()}


def blob(axis, k, wobble=0.05, dim=16):
    v = np.zeros(dim)
    v[axis] = 1
    v[(axis + 1 + k % 5) % dim] += wobble * (k + 1)
    return (v / np.linalg.norm(v)).tolist()


def test_overview_by_person_then_cluster(spark):
    f = faces(spark, (1, 1, 10, 1, 1), (2, 2, 10, 1, 0), (3, 3, 10, 2, 1), (4, 4, 10, None, 0), (5, 5, 20, None, 0))
    got = {r["g"]: (r["count"], r["name"]) for r in people.overview(f, named(spark, (1, "Mía"), (2, "Camila"))).collect()}
    assert got == {-1: (2, "Mía"), -2: (1, "Camila"), 10: (1, None), 20: (1, None)}


def test_merge_moves_faces_and_clears_the_empty_name(spark):
    f = faces(spark, (1, 1, 10, 1, 1), (8, 8, 10, 3, 1), *[(i, i, 20, 2, 1) for i in range(3, 8)], (9, 9, 20, 2, 0))
    out, who = mutations.merge_group(f, named(spark, (1, "Mía"), (2, "Camila"), (3, "Lianny")), 1, -2)
    got = state(out)
    assert all(got[i][0] == 1 for i in (1, 3, 4, 5, 6, 7, 9)) and got[8] == (3, 1)
    assert {r["id"]: r["cluster_id"] for r in out.collect()} == {r["id"]: r["cluster_id"] for r in f.collect()}
    assert {r["id"]: r["name"] for r in who.collect()} == {1: "Mía", 2: None, 3: "Lianny"}


def test_ensure_binds_free_faces_only(spark):
    f = faces(spark, (1, 1, 10, 1, 1), (2, 2, 10, None, 0))
    out, who, made = mutations.ensure_identity(f, named(spark, (1, "Mía")), 10)
    assert made == 2 and state(out) == {1: (1, 1), 2: (2, 0)} and who.count() == 2
    with pytest.raises(StaleVersion):
        mutations.ensure_identity(out, who, 10)
    assert mutations.ensure_identity(out, who, -1)[2] == 1


def test_naming_and_undo(spark):
    f, who = faces(spark, (1, 1, 10, None, 0), (2, 2, 10, None, 0)), named(spark, (7, "Ann"))
    before = mutations.capture(f, [1, 2])
    out, ids, group = mutations.name_group(f, who, 10, " Mía ")
    assert group == -8 and state(out) == {1: (8, 1), 2: (8, 1)} and {r["id"]: r["name"] for r in ids.collect()}[8] == "Mía"
    assert [r["g"] for r in people.group_for_name(out, ids, "mía").collect()] == [-8]
    c = catalog(spark, out, ids).commit(0)
    assert state(mutations.undo(c, before, name=(8, None)).faces) == {1: (None, 0), 2: (None, 0)}
    with pytest.raises(StaleVersion):
        c.commit(0)
    assert {r["name"] for r in mutations.name_group(out, ids, -8, " ")[1].collect()} == {"Ann", None}


def test_other_named_people_are_guarded(spark):
    f, who = faces(spark, (1, 1, 10, 1, 1), (2, 2, 20, 2, 1), (3, 3, 30, 3, 1)), named(spark, (1, "A"), (2, "B"), (3, None))
    assert mutations.is_other_named(f, who, -2, 1) and not mutations.is_other_named(f, who, -3, 1)
    assert not mutations.is_other_named(f, who, -1, 1) and not mutations.is_other_named(f, who, 20, 1)
    c = mutations.absorb(catalog(spark, f, who), -1, [-2, -3, -1])
    assert state(c.faces) == {1: (1, 1), 2: (2, 1), 3: (1, 1)}


def test_same_photo_answers(spark):
    f = faces(spark, (1, 9, 10, None, 0), (2, 9, 20, None, 0), (3, 8, 10, None, 0), (4, 7, 20, None, 0))
    assert [tuple(r) for r in people.cooccurring_pairs(f, 10, 20).collect()] == [(9, 1, 2)]
    yes = mutations.resolve_same_photo(catalog(spark, f, named(spark, (1, "A"))), 10, 20, True)
    assert {s for s in state(yes.faces).values()} == {(2, 1)} and [tuple(r) for r in yes.same_photo_ok.collect()] == [(1, 2)]
    no = mutations.resolve_same_photo(catalog(spark, f, named(spark, (1, "A"))), 10, 20, False)
    assert [tuple(r) for r in no.cannot_link.collect()] == [(2, 3)] and {s[1] for s in state(no.faces).values()} == {1}


def test_detach_ignore_reassign(spark):
    f, who = faces(spark, (1, 1, 10, 1, 1), (2, 2, 10, 1, 1)), named(spark, (1, "A"))
    assert state(mutations.detach(f, [1])) == {1: (None, 0), 2: (1, 1)}
    assert {r["id"]: (r["ignored"], r["cluster_id"]) for r in mutations.ignore(f, [2]).collect()} == {1: (0, 10), 2: (1, 10)}
    c = mutations.reassign(catalog(spark, f, who), [2], -1, None, "Bo")
    assert state(c.faces)[2] == (2, 1) and [tuple(r) for r in c.cannot_link.collect()] == [(1, 2)]
    again = mutations.not_this_person(catalog(spark, faces(spark, (1, 1, 10, 1, 1), (5, 5, 50, None, 0)), who), 50, [-1])
    assert [tuple(r) for r in again.cannot_link.collect()] == [(1, 2)] and state(again.faces)[5] == (2, 1)


def groups_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def vectors_of(spark, *vs, photos=None):
    return faces(spark, *[(i + 1, photos[i] if photos else i + 1, i + 1, None, 0, v) for i, v in enumerate(vs)])


def test_blobs_separate_and_bridges_do_not_chain(spark):
    a, b = [blob(0, k) for k in range(4)], [blob(8, k) for k in range(4)]
    bridge = [0.0] * 16
    bridge[0] = bridge[8] = 0.72
    got = groups_of(clusters.recluster(vectors_of(spark, *a, *b, bridge)))
    assert [1, 2, 3, 4] in [g[:4] for g in got] and not any(set(g) & {1, 2, 3, 4} and set(g) & {5, 6, 7, 8} for g in got)


def test_constraints_keep_faces_apart(spark):
    f = vectors_of(spark, *[blob(0, k) for k in range(4)], photos=[1, 1, 2, 3])
    ids = spark.createDataFrame([(1, 1), (4, 2)], "id long, identity_id long")
    got = groups_of(clusters.recluster(f, DEFAULT, f.select("id", "photo_id"), ids, links(spark, (1, 2))))
    assert not any({1, 2} <= set(g) or {1, 4} <= set(g) for g in got)
    free = groups_of(clusters.recluster(f, DEFAULT, f.select("id", "photo_id"), None, None, links(spark, (1, 2))))
    assert free == [[1, 2, 3, 4]]



def test_incremental_votes(spark):
    index = clusters.Index([1, 1, 1], [1, 2, 3], np.array([blob(0, k) for k in range(3)]))
    assert index.assign(np.array(blob(0, 1)), 9) == 1
    assert index.assign(np.array(blob(8, 0)), 9) == 2
    assert index.assign(np.array(blob(0, 1)), 1) == 3  # its photo has a face of that cluster already
    e = np.eye(16)
    spread = clusters.Index([1, 1, 1], [1, 2, 3], np.array([e[0], e[0] + 0.05 * e[1], 0.45 * e[0] + 0.893 * e[5]]))
    assert spread.assign(0.6 * e[0] + 0.8 * e[7], 9) == 2
    known, new = vectors_of(spark, *[blob(0, k) for k in range(3)]).withColumn("cluster_id", F.lit(1).cast("long")), faces(spark, (50, 90, None, None, 0, blob(0, 1)), (51, 91, None, None, 0, blob(9, 1)))
    assert {r["id"]: r["cluster"] for r in clusters.assign_batch(known, new).collect()} == {50: 1, 51: 2}


def test_batches_give_what_an_index_gives(spark):
    """Arrivals by distributed neighbours against one index that sees every face in turn."""
    rng = np.random.default_rng(5)
    mat = rng.normal(size=(160, 4)).astype(np.float32)
    params = DEFAULT.__class__(**{**DEFAULT.__dict__, "k": 5, "link": 0.55, "duplicate": 0.97})
    photo = [int(x) for x in rng.integers(0, 60, 160)]
    cluster = [int(x) for x in np.argmax(mat[:90] @ rng.normal(size=(4, 9)), axis=1) + 1]
    known = spark.createDataFrame([(i, cluster[i], photo[i], mat[i].tolist()) for i in range(90)], "id long, cluster_id long, photo_id long, embedding array<float>").repartition(5)
    new = spark.createDataFrame([(i, photo[i], mat[i].tolist()) for i in range(90, 160)], "id long, photo_id long, embedding array<float>")
    index = clusters.Index(cluster, photo[:90], mat[:90].astype(float), params)
    want = {i: index.assign(mat[i].astype(float), photo[i]) for i in range(90, 160)}
    assert {r["id"]: r["cluster"] for r in clusters.assign_batch(known, new, params).collect()} == want
    assert len({c for c in want.values() if c < index.next}) > 5
    assert clusters.assign_batch(known, new.limit(0), params).count() == 0
    assert {r["cluster"] for r in clusters.assign_batch(known.limit(0), new.limit(1), params).collect()} == {1}


def test_matches_with_anchor_cores(spark, sf_dir):
    """The default, trimmed form by plain loops: anchors, their dominant look, scores, and groups that match."""
    from heliograph.operators import recognition
    from heliograph.plans.catalogue import LOOSE
    from heliograph.sources import fixtures

    table = fixtures.faces(spark, sf_dir)
    every = [r for r in table.collect() if r["cluster_id"] is not None and not r["ignored"]]
    pool = [(r["id"], -r["identity_id"] if r["identity_id"] else r["cluster_id"], np.array(r["embedding"], dtype=np.float64)) for r in every]
    core = {}
    for person in {r["identity_id"] for r in every if r["confirmed"] == 1 and r["identity_id"]}:
        own = sorted((r for r in every if r["identity_id"] == person and r["confirmed"] == 1), key=lambda r: (-r["score"], r["id"]))[: LOOSE.anchor_size]
        vectors_ = np.array([r["embedding"] for r in own], dtype=np.float64)
        if len(own) >= LOOSE.core_floor:
            biggest = max(reversed(clusters.leader_groups(vectors_, LOOSE.core_tau)), key=len)
            vectors_ = vectors_[sorted(biggest)] if 2 * len(biggest) >= len(own) else vectors_
        core[person] = vectors_
    want = {}
    for person, anchors_ in core.items():
        for g in {g for _, g, _ in pool if g != -person}:
            scores = [float(np.sort(anchors_ @ v)[::-1][: LOOSE.anchor_top].mean()) for _, h, v in pool if h == g]
            hits = [x for x in scores if x >= LOOSE.link]
            if 2 * len(hits) >= len(scores) and len(hits) >= max(1, min(2, len(scores))):
                want[(person, g)] = (len(scores), len(hits), round(max(hits), 6))
    got = {(r["identity_id"], r["g"]): (r["size"], r["matched"], round(r["max_sim"], 6)) for r in recognition.matches(table, LOOSE).collect()}
    assert got == want and want


def test_leaders_and_core(spark):
    mat = np.array([blob(0, 0), blob(8, 0), blob(0, 1), blob(8, 1), blob(0, 2)])
    assert clusters.leader_groups(mat, 0.5) == [[0, 2, 4], [1, 3]]
    f = faces(spark, *[(i, i, 1, 1, 1, blob(0, i % 4)) for i in range(1, 7)], (7, 7, 1, 1, 1, blob(8, 0)))
    assert sorted(r["id"] for r in clusters.anchor_core(vectors.anchors(f, 64)).collect()) == [1, 2, 3, 4, 5, 6]


def test_boxes():
    assert clusters.suppress([(0, 0, 2, 2), (0, 0, 2, 1.9), (5, 5, 6, 6)], [0.5, 0.9, 0.1]) == [1, 2]
    src = np.array([[0, 0], [1, 0], [0, 1]], float)
    m = clusters.similarity_transform(src, src @ np.array([[0, 2], [-2, 0]]) + [3, 4])
    assert np.allclose(m, [[0, -2, 3], [2, 0, 4]])
    assert clusters.sample(np.array([[0.0, 1.0], [2.0, 3.0]]), np.array([0.5, 5.0]), np.array([0.5, 0.0])).tolist() == [1.5, 0.0]


def engine(spark, *rows):
    return faces(spark, *rows)


def test_folds(spark):
    omar = [(i, i, 100, 1, 1, blob(0, i % 4, 0.03)) for i in range(1, 6)]
    kevin = [(i, i, 200, 2, 1, blob(7, i % 4, 0.03)) for i in range(11, 16)]
    decide = lambda *extra: {(r["g"], r["identity_id"]) for r in recognition.fold_decisions(engine(spark, *omar, *kevin, *extra)).collect()}
    mix = [0.0] * 16
    mix[0], mix[7] = 0.72, 0.69
    assert decide((21, 50, 300, None, 0, blob(0, 1, 0.03))) == {(300, 1)}
    assert decide((22, 51, 301, None, 0, mix)) == set()  # a near tie
    assert decide((23, 1, 302, None, 0, blob(0, 1, 0.03))) == set()  # pictured with the person
    thin = engine(spark, *omar[:3], (21, 50, 300, None, 0, blob(0, 1, 0.03)))
    assert recognition.fold_decisions(thin).count() == 0
    wrong = engine(spark, *omar, *kevin, (24, 60, 303, 2, 0, blob(0, 2, 0.03)))
    photos = spark.createDataFrame([(1, 1, 1)], "id long, thumb_status int, faces_scanned int")
    assert state(recognition.auto_fold(photos, wrong))[24] == (1, 0)
    unsettled = spark.createDataFrame([(1, 1, 0)], "id long, thumb_status int, faces_scanned int")
    assert state(recognition.auto_fold(unsettled, wrong))[24] == (2, 0)


def test_contested_groups_and_queue(spark):
    mix = [0.0] * 16
    mix[0], mix[7] = 0.71, 0.7
    rows = [(i, i, 100, 1, 1, blob(0, i % 4, 0.03)) for i in range(1, 6)] + [(i, i, 200, 2, 1, blob(7, i % 4, 0.03)) for i in range(11, 16)]
    rows += [(i, i, 300, None, 0, mix) for i in range(21, 26)] + [(i, i, 400, None, 0, blob(0, 1, 0.03)) for i in range(31, 40)] + [(41, 41, 500, None, 0, blob(7, 1, 0.03))]
    f, who = engine(spark, *rows), named(spark, (1, "Omar"), (2, "Kevin"))
    claims = recognition.growth_claims(f, who)
    assert {(r["g"], tuple(r["candidates"])) for r in recognition.who_is_this(claims).collect()} == {(300, (1, 2))}
    merges = spark.createDataFrame([], "kind string, target long, source long, target_name string, similarity double, photos long, photo_id long")
    queue = [(r["kind"], r["subject"], r["photos"]) for r in recognition.review_queue(claims, merges.withColumnRenamed("target", "into").withColumnRenamed("into", "target")).collect()]
    assert queue == [("strong", -1, 9), ("who", 300, 5)]  # one photo is too few for a card
    cards = recognition.review_queue(claims, merges)
    assert recognition.prune_cards(cards, spark.createDataFrame([(300,)], "g long")).count() == 1


def test_person_looks(spark):
    rows = [(i, i, 100, 1, 1 if i < 5 else 0, blob(0, i % 3, 0.02)) for i in range(1, 13)] + [(i, i, 100, 1, 0, blob(8, i % 3, 0.02)) for i in range(13, 25)]
    f = faces(spark, *rows)
    photos = spark.createDataFrame([(i, i * 10, None) for i in range(1, 25)], "id long, mtime long, taken_ts long")
    looks = recognition.person_looks(photos, f, named(spark, (1, "A")), links(spark), -1).collect()
    assert sorted((r["photos"], r["from_ts"], r["to_ts"]) for r in looks) == [(12, 10, 120), (12, 130, 240)]
    few = recognition.person_looks(photos, f.filter("id < 10"), named(spark, (1, "A")), links(spark), -1)
    assert few.count() == 0


def test_knn_blocks_agree(spark):
    np.random.seed(5)
    f = vectors_of(spark, *np.random.randn(60, 6).tolist()).withColumn("embedding", vectors.normalized(F.col("embedding")))
    one = sorted(map(tuple, vectors.knn(f, 5, 0.1).select("i", "j", "rank").collect()))
    assert one == sorted(map(tuple, vectors.knn(f, 5, 0.1, block=17).select("i", "j", "rank").collect())) and one


def test_bursts(spark, tmp_path):
    from heliograph.streaming import watch

    events = pd.DataFrame({"root": ["r"] * 4, "path": ["/a.jpg", "/b.jpg", "/.x/c.jpg", "/d.jpg"], "ts": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:10:00"])})
    spark.createDataFrame(events).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("root string, path string, ts timestamp").parquet(str(tmp_path / "in"))
    q = watch.burst_windows(watch.relevant(stream), "root").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["n"] for r in spark.sql("select * from bursts").collect()] == [2]


def test_decisions_on_another_version_are_refused(spark):
    c = catalog(spark, faces(spark, (1, 1, 10, 1, 1), (2, 2, 20, None, 0), (3, 3, 30, None, 0)), named(spark, (1, "A"), (2, "B")))
    now = mutations.merge_groups(c, -1, 20, expected=0)
    assert now.version == 1
    f = c.faces
    for decide in (
        lambda v: mutations.reject_merge(now, -1, 30, expected=v), lambda v: mutations.not_this_person(now, 30, [-1], expected=v),
        lambda v: mutations.absorb(now, -1, [30], expected=v), lambda v: mutations.merge_groups(now, -1, 30, expected=v),
        lambda v: mutations.resolve_same_photo(now, -1, 30, False, expected=v), lambda v: mutations.reassign(now, [3], -1, None, "C", expected=v),
        lambda v: mutations.undo(now, mutations.capture(f, [2]), expected=v), lambda v: mutations.reset_all_faces(f.withColumn("faces_scanned", F.lit(1)), now, expected=v),
        lambda v: mutations.confirm_into(now, [3], -1, expected=v)[0], lambda v: mutations.name_faces(now, [3], "A", expected=v)[0],
        lambda v: mutations.split(now, {-1: [3]}, [2], expected=v)[0],
    ):
        with pytest.raises(StaleVersion):
            decide(0)
        assert decide(1).version > 1 and decide(None).version > 1


def test_ids_as_a_table_or_a_list(spark):
    c = catalog(spark, faces(spark, (1, 1, 10, 1, 1), (2, 2, 10, 1, 1), (3, 3, 30, None, 0)), named(spark, (1, "A"), (2, "B")))
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    for pick in (lambda *ids: list(ids), table):
        out, prior = mutations.split(c, {-2: pick(3)}, pick(2))
        assert state(out.faces) == {1: (1, 1), 2: (None, 0), 3: (2, 1)}
        assert state(mutations.undo(out, prior).faces) == state(c.faces)
        assert state(mutations.reassign(c, pick(3), None, -2).faces)[3] == (2, 1)

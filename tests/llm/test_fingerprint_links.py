"""Links that are counted by distance to a centre against all pairs listed."""

import random
from collections import Counter

from pyspark.sql import functions as F

from heliograph.llm import fingerprints, words


def test_links_around_a_centre_are_counted_without_being_listed(spark):
    rng = random.Random(21)
    base = [rng.choice(["the", "of", f"w{i}"]) if i % 3 else f"c{i}" for i in range(300)]
    rows = []
    for d in range(60):
        words = list(base)
        for _ in range(1 + d % 9):
            words[rng.randrange(len(words))] = f"odd{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spots = docs.select("doc_id", fingerprints.chains(F.col("text")).alias("spots")).withColumn("key", fingerprints.class_key(F.col("spots")))
    classes = fingerprints.fingerprint_classes(spots, 0.8)
    every = fingerprints.class_pairs(spots, classes, 0.8).select("a_id", "b_id").collect()
    listed = fingerprints.class_pairs(spots, classes, 0.8, fingerprints.near_centres(spots, classes, 0.8)).count()
    assert len(every) > 600 and listed < len(every) / 2
    want = Counter(x for r in every for x in (r["a_id"], r["b_id"]))
    got = {r["class_id"]: r["n_links"] for r in fingerprints.class_links(spots, 0.8).collect()}
    assert got == {d: want[d] for d in range(60)}


def prints_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("doc_id", fingerprints.chains(F.col("text")).alias("spots")).withColumn("key", fingerprints.class_key(F.col("spots")))


def test_links_of_one_centre_are_told_by_edits(spark):
    rng = random.Random(5)
    base = [rng.choice(["the", "of", f"w{i}"]) if i % 3 else f"c{i}" for i in range(150)]
    rows = []
    for d in range(90):
        words = list(base)
        for _ in range(2 + d % 5):
            k = rng.randrange(len(words))
            words[k] = f"odd{k}" if d % 2 else f"odd{rng.randrange(10**6)}"  # some edits are shared
        rows.append((d, " ".join(words)))
    spots = prints_of(spark, rows)
    for threshold in (0.8, 0.75, 0.78539816339):  # the last is no fraction of small numbers
        classes = fingerprints.fingerprint_classes(spots, threshold)
        near = fingerprints.near_centres(spots, classes, threshold)
        every = fingerprints.class_pairs(spots, classes, threshold).select("a_id", "b_id").collect()
        listed = fingerprints.class_pairs(spots, classes, threshold, near).count()
        assert 200 < len(every) < 90 * 89 / 2  # not all are linked
        assert listed < len(every) / 4 or threshold == 0.78539816339
        want = Counter(x for r in every for x in (r["a_id"], r["b_id"]))
        got = {r["class_id"]: r["n_links"] for r in fingerprints.class_links(spots, threshold).collect()}
        assert got == {r["id"]: want[r["id"]] for r in classes.select("id").collect()}


def test_rows_without_copies_or_links_need_no_join(spark, monkeypatch):
    monkeypatch.setattr(words, "BROADCAST_ROWS", 20)
    rows = [(d, " ".join(f"the a{d}b{i} w{i * d}" for i in range(20))) for d in range(60)] + [(99, "the one text twice here"), (100, "the one text twice here")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan  # the few that have, not a shuffle of all fingerprints
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == {d: (min(d, 99), 0) for d, _ in rows}

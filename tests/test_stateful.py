"""Streams with keyed state against plain loops, over the given tables, with restarts."""

import random
import time
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import clusters
from heliograph.plans.params import Params
from heliograph.streaming import stateful

#: Looser than the library's, as the synthetic vectors are hardly alike.
LOOSE = Params(link=0.15, duplicate=0.3)


def parts(df, order, n, folder):
    """``df`` as ``n`` files, in order, that a stream takes one at a time."""
    rows = df.orderBy(order).collect()
    for k in range(n):
        own = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        df.sparkSession.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.1)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(df, folder, sink=None):
    q = df.writeStream.foreachBatch(sink or stateful.batch_sink(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()


def test_identities_over_embeddings_with_a_restart(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding is not null")
    faces = rows.select((F.col("vec_id") % 2).alias("library"), F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 3).alias("photo_id"), "embedding")
    stream = stateful.identities(parts(faces, "id", 3, tmp_path), LOOSE)
    tries = []

    def fails_once(batch, batch_id):
        """The second batch is written, and then its query ends before it is done."""
        stateful.batch_sink(f"{tmp_path}/out")(batch, batch_id)
        tries.append(batch_id)
        if tries == [0, 1]:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(stream, tmp_path, fails_once)
    run(stateful.identities(spark.readStream.schema(faces.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), LOOSE), tmp_path, fails_once)
    assert tries == [0, 1, 1, 2]
    got = {r["id"]: r["cluster"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for library in (0, 1):
        index = clusters.Index([], [], np.empty((0, 1)), LOOSE)
        for r in faces.filter(F.col("library") == library).orderBy("id").collect():
            want[r["id"]] = index.assign(r["embedding"], r["photo_id"])
    assert got == want and 1 < len({(i % 2, c) for i, c in want.items()}) < len(want) - 50


class Plain:
    """The queue as lists."""

    def __init__(self):
        self.jobs, self.normal, self.priority, self.running = set(), deque(), deque(), set()

    def act(self, action, ids):
        if action == "enqueue":
            for i in ids:
                if i not in self.jobs and i not in self.running:
                    self.jobs.add(i)
                    self.normal.append(i)
        elif action == "priority":
            self.priority = deque(i for i in dict.fromkeys(ids) if i in self.jobs)
        elif action == "cancel":
            self.jobs -= set(ids)
            self.normal = deque(i for i in self.normal if i not in ids)
            self.priority = deque(i for i in self.priority if i not in ids)
        elif action == "complete":
            self.running -= set(ids)
        elif action == "take":
            for lane in (self.priority, self.normal):
                while lane:
                    i = lane.popleft()
                    if i in self.jobs:
                        self.jobs.remove(i)
                        self.running.add(i)
                        if i in self.normal:
                            self.normal.remove(i)
                        return i
        return None


def test_queue_over_events(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(900)
    first = events.columns[0]
    kind = F.element_at(F.array(*[F.lit(a) for a in ("enqueue", "take", "take", "enqueue", "priority", "complete", "cancel")]), (F.pmod(F.xxhash64(first), F.lit(7)) + 1).cast("int"))
    ids = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.pmod(F.xxhash64(F.col(first), k), F.lit(25)))
    script = events.select(F.when(F.pmod(F.xxhash64(first, F.lit(1)), F.lit(3)) == 0, "cloud").otherwise("local").alias("lane"), F.col(first).cast("long").alias("seq"), kind.alias("action"), ids.alias("ids"))
    run(stateful.queue(parts(script, "seq", 3, tmp_path)), tmp_path)
    got = sorted((r["lane"], r["seq"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    queues, want = {"cloud": Plain(), "local": Plain()}, []
    for r in script.orderBy("seq").collect():
        job = queues[r["lane"]].act(r["action"], r["ids"])
        want += [(r["lane"], r["seq"], job)] if job is not None else []
    assert got == sorted(want) and len(got) > 50


def test_announcer_by_a_manual_clock():
    a = stateful.Announcer(cooldown_ms=45_000)
    a.see({1: 20})
    assert a.tell(0) is None
    a.see({1: 30, 2: 9, 3: 12, 4: 9})
    assert a.tell(1_000) == (3, 12) and a.tell(45_999) is None and a.tell(46_000) == (2, 9)
    a.see({3: 40, 4: 11})
    assert a.tell(90_999) is None and a.tell(91_000) == (4, 11) and a.tell(10**9) is None


def test_a_held_announcement_comes_without_new_rows(spark, tmp_path):
    schema = "shelf string, g long, count long"
    put = lambda *rows: spark.createDataFrame([("s", *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put((1, 9))
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = stateful.announcements(stream, 8, 4).writeStream.foreachBatch(stateful.batch_sink(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    told = lambda: sorted((r["at_ms"], r["g"]) for r in spark.read.schema("shelf string, g long, count long, at_ms long, batch int").parquet(f"{tmp_path}/out").collect())
    end = time.time() + 60
    try:
        while time.time() < end and not (tmp_path / "out" / "batch=0" / "_SUCCESS").exists():
            time.sleep(0.2)
        put((2, 9), (3, 10), (4, 3))
        while time.time() < end and ((tmp_path / "out").exists() is False or len(told()) < 2):
            time.sleep(0.5)
            assert q.exception() is None
    finally:
        q.stop()
    got = told()
    assert [g for _, g in got] == [3, 2] and got[1][0] - got[0][0] >= 4000

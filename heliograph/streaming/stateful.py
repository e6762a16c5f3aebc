"""Keyed state that streams keep: identities, the work queue, announcements with a cooldown.

All need a RocksDB state store (``with_state`` sets it). State and sources move on together, a batch
that is run again starts from the state that it started from before, and ``batch_sink`` writes a
batch over its own earlier try, so a restart gives the same rows once.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heliograph.operators.clusters import unit_rows
from heliograph.plans.params import DEFAULT, Params
from heliograph.scratch import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Faces in a page of a cell's state; cells that the vector space is cut into.
PAGE, CELLS = 256, 32


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship(spark)
    return spark


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink with a folder a batch; a batch that is run again replaces what it wrote."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


class Identities(StatefulProcessor):
    """Clusters of new faces of a library, each matched against all before it.

    Faces lie in the cell of the nearest of some fixed directions, in pages. A new face is compared
    with the cells that may hold one of the link similarity or more, by angles and the cells' radii.
    A cluster fits as a whole if as many of its faces as it has were found near.
    """

    def __init__(self, params: Params = DEFAULT, cells: int = CELLS):
        self.params, self.n_cells = params, cells

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "next long, seq long")
        self.cells = handle.getMapState("cells", "cell int", "pages int, radius double")
        self.pages = handle.getMapState("pages", "cell int, page int", "seq array<long>, cluster array<long>, vectors binary")
        self.sizes = handle.getMapState("sizes", "cluster long", "n long")
        self.photos = handle.getMapState("photos", "photo long", "clusters array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("id")
        mat = unit_rows(np.vstack(batch["embedding"]))
        dim = mat.shape[1]
        directions = unit_rows(np.random.default_rng(0).normal(size=(self.n_cells, dim)))
        following, seq = self.counters.get() if self.counters.exists() else (1, 0)
        meta = {k[0]: list(v) for k, v in self.cells.iterator()}
        held: dict[int, list] = {}  # cells that this batch has read: seq, cluster, vectors
        grown: dict[int, int] = {}  # the first page of a cell that has changed
        sizes: dict[int, int] = {}
        limit = np.arccos(min(1.0, max(-1.0, self.params.link))) + 1e-6
        out = []

        def cell(c: int) -> list:
            if c not in held:
                found = [self.pages.getValue((c, p)) for p in range(meta.get(c, [0])[0])]
                held[c] = [[s for f in found for s in f[0]], [g for f in found for g in f[1]], [v for f in found for v in np.frombuffer(f[2]).reshape(-1, dim)]]
            return held[c]

        def size(g: int) -> int:
            if g not in sizes:
                sizes[g] = self.sizes.getValue((g,))[0] if self.sizes.containsKey((g,)) else 0
            return sizes[g]

        for face, photo, v in zip(batch["id"].tolist(), batch["photo_id"].tolist(), mat):
            photo = None if pd.isna(photo) else int(photo)
            far = np.arccos(np.clip(directions @ v, -1, 1))
            near: list[tuple[float, int, int]] = []
            for c in sorted(meta):
                if far[c] - meta[c][1] <= limit:
                    seqs, clusters, vectors = cell(c)
                    sims = np.array(vectors) @ v
                    near += [(-float(sims[i]), seqs[i], clusters[i]) for i in np.flatnonzero(sims >= self.params.link)]
            near.sort()
            found = Counter(g for _, _, g in near)
            barred = set(self.photos.getValue((photo,))[0]) if photo is not None and self.photos.containsKey((photo,)) else set()
            top = near[: self.params.k]
            votes = Counter(g for _, _, g in top)
            good = [(-n, g) for g, n in votes.items() if n >= self.params.min_votes and g not in barred and found[g] == size(g)]
            if top and -top[0][0] >= self.params.duplicate and top[0][2] not in barred:
                chosen = top[0][2]
            elif good:
                chosen = min(good)[1]
            else:
                chosen, following = following, following + 1
            home = int(far.argmin())
            own = cell(home)
            grown.setdefault(home, len(own[0]) // PAGE)
            for column, value in zip(own, (seq, chosen, v)):
                column.append(value)
            meta[home] = [-(-len(own[0]) // PAGE), max(meta.get(home, [0, 0.0])[1], float(far[home]))]
            sizes[chosen] = size(chosen) + 1
            self.sizes.updateValue((chosen,), (sizes[chosen],))
            if photo is not None and chosen not in barred:
                self.photos.updateValue((photo,), (sorted(barred | {chosen}),))
            seq += 1
            out.append((int(face), chosen))
        for c, first in grown.items():
            for p in range(first, meta[c][0]):
                seqs, clusters, vectors = (column[p * PAGE : (p + 1) * PAGE] for column in held[c])
                self.pages.updateValue((c, p), (seqs, clusters, np.array(vectors).tobytes()))
            self.cells.updateValue((c,), tuple(meta[c]))
        self.counters.update((following, seq))
        yield pd.DataFrame({"library": key[0], "id": [f for f, _ in out], "cluster": [c for _, c in out]})

    def close(self) -> None:
        pass


def identities(faces: DataFrame, params: Params = DEFAULT, cells: int = CELLS) -> DataFrame:
    """(library, id, cluster) of a stream of faces (library, id, photo_id, embedding), in id order within a batch.

    A library is one key: its faces are matched one after the other, as each sees those before it.
    """
    with_state(faces.sparkSession)
    rows = faces.select("library", "id", "photo_id", "embedding").groupBy("library")
    return rows.transformWithStateInPandas(Identities(params, cells), "library long, id long, cluster long", "Append", "None")


class Queue(StatefulProcessor):
    """Two lanes of jobs: what is on screen first, then first come first served; a job is queued once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lanes = handle.getValueState("lanes", "head long, tail long, priority array<long>")
        self.places = handle.getMapState("places", "place long", "id long")
        self.jobs = handle.getMapState("jobs", "id long", "place long")
        self.running = handle.getMapState("running", "id long", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("seq")
        head, tail, priority = self.lanes.get() if self.lanes.exists() else (0, 0, [])
        priority = deque(priority or [])
        taken = []

        def start(job: int, seq: int) -> None:
            self.jobs.removeKey((job,))
            self.running.updateValue((job,), (seq,))
            taken.append((seq, job))

        for seq, action, ids in zip(batch["seq"].tolist(), batch["action"], batch["ids"]):
            ids = [int(i) for i in ids] if ids is not None else []
            if action == "enqueue":
                for i in ids:
                    if not self.jobs.containsKey((i,)) and not self.running.containsKey((i,)):
                        self.places.updateValue((tail,), (i,))
                        self.jobs.updateValue((i,), (tail,))
                        tail += 1
            elif action == "priority":
                priority = deque(i for i in dict.fromkeys(ids) if self.jobs.containsKey((i,)))
            elif action == "cancel":
                for i in set(ids):
                    if self.jobs.containsKey((i,)):
                        self.places.removeKey(self.jobs.getValue((i,)))
                        self.jobs.removeKey((i,))
                priority = deque(i for i in priority if i not in ids)
            elif action == "complete":
                for i in ids:
                    if self.running.containsKey((i,)):
                        self.running.removeKey((i,))
            elif action == "take":
                while priority and not self.jobs.containsKey((priority[0],)):
                    priority.popleft()
                if priority:
                    job = priority.popleft()
                    self.places.removeKey(self.jobs.getValue((job,)))
                    start(job, seq)
                    continue
                while head < tail:
                    place, head = (head,), head + 1
                    if self.places.containsKey(place):
                        (job,) = self.places.getValue(place)
                        self.places.removeKey(place)
                        start(job, seq)
                        break
        self.lanes.update((head, tail, list(priority)))
        yield pd.DataFrame({"lane": key[0], "seq": [s for s, _ in taken], "id": [i for _, i in taken]}).astype({"seq": "int64", "id": "int64"})

    def close(self) -> None:
        pass


def queue(events: DataFrame) -> DataFrame:
    """(lane, seq, id): the job that each ``take`` got, of a stream of (lane, seq, action, ids).

    Actions are enqueue, priority (which replaces the ids on screen), cancel, take and complete, in
    the order of ``seq``; a job that is queued or being worked on isn't queued again, and a take
    that finds nothing gives no row.
    """
    with_state(events.sparkSession)
    return events.select("lane", "seq", "action", "ids").groupBy("lane").transformWithStateInPandas(Queue(), "lane string, seq long, id long", "Append", "None")


class Announcer:
    """New groups of a shelf: the largest one is told, the next no sooner than a cooldown later."""

    def __init__(self, known: list[int] | None = None, waiting: dict[int, int] | None = None, free_at: int = 0, cooldown_ms: int = 45_000):
        self.known, self.waiting, self.free_at, self.cooldown_ms = known, dict(waiting or {}), free_at, cooldown_ms

    def see(self, counts: dict[int, int]) -> None:
        """Counts of unnamed groups at the floor or above; what the first look holds is known already."""
        if self.known is None:
            self.known = sorted(counts)
            return
        self.waiting |= {g: n for g, n in counts.items() if g not in self.known}

    def tell(self, now: int) -> tuple[int, int] | None:
        """The (group, count) to announce now, if any."""
        if not self.waiting or now < self.free_at:
            return None
        g = min(self.waiting, key=lambda g: (-self.waiting[g], g))
        self.known, self.free_at = sorted({*self.known, g}), now + self.cooldown_ms
        return g, self.waiting.pop(g)


class Announcements(StatefulProcessor):
    def __init__(self, floor: int, cooldown_ms: int):
        self.floor, self.cooldown_ms = floor, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "told string")

    def _load(self) -> Announcer:
        kept = json.loads(self.state.get()[0]) if self.state.exists() else {}
        return Announcer(kept.get("known"), {int(g): n for g, n in kept.get("waiting", {}).items()}, kept.get("free_at", 0), self.cooldown_ms)

    def _keep(self, a: Announcer) -> None:
        self.state.update((json.dumps({"known": a.known, "waiting": a.waiting, "free_at": a.free_at}),))
        if a.waiting:  # the same timer however often it is set, as a cooldown's end moves only when one is told
            self.handle.registerTimer(a.free_at)

    def _tell(self, key, a: Announcer, now: int) -> pd.DataFrame:
        told = a.tell(now)
        self._keep(a)
        rows = [(key[0], *told, now)] if told else []
        return pd.DataFrame(rows, columns=["shelf", "g", "count", "at_ms"]).astype({"g": "int64", "count": "int64", "at_ms": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        a = self._load()
        a.see({int(g): int(n) for g, n in zip(batch["g"], batch["count"]) if n >= self.floor})
        yield self._tell(key, a, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._tell(key, self._load(), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def announcements(groups: DataFrame, floor: int = 8, cooldown_s: float = 45) -> DataFrame:
    """(shelf, g, count, at_ms) of a stream of unnamed groups (shelf, g, count) that reach the floor.

    What comes during a cooldown waits for its end, which a processing-time timer brings about
    without new rows. What a shelf's first batch holds counts as known.
    """
    with_state(groups.sparkSession)
    rows = groups.select("shelf", "g", "count").groupBy("shelf")
    return rows.transformWithStateInPandas(Announcements(floor, int(cooldown_s * 1000)), "shelf string, g long, count long, at_ms long", "Append", "ProcessingTime")

"""Similarity over vectors: neighbours, edges, evidence, anchors.

Dot products fold an ordered array in double, so they don't depend on partitioning. The exact
neighbour search gathers vectors in blocks around pivots, and a vector calls only on blocks that
may hold a near one; a task holds some blocks' vectors, and those that call on them stream past it,
while each vector keeps its own best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.plans.params import DEFAULT, Params
from heliograph.scratch import ship, written

#: Vectors in a block; most that a task holds; rows of these that are multiplied with a batch at once.
BLOCK = 16384
HELD = 65536
STRIPE = 512
#: Pairs whose ordered fold is taken at once.
FOLDED = 32768
#: Blocks' centres, which every task gets; components that are multiplied first.
PIVOTS, HEAD = 1024, 16
#: Anchors sent to all tasks at once; more are sent in turns.
ANCHORS_AT_ONCE = 16384


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    return F.transform(v, lambda x: x.cast("double") / length)


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(v, axis=1)
    return v / np.maximum(norm, 1e-12)[:, None], norm


def near_pairs(a: np.ndarray, b: np.ndarray, min_sim: float, head: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, similarities of these): no pair left out can reach ``min_sim``.

    The leading components are multiplied first; what the others can add is at most the product
    of their lengths, and rows that reach nothing with that are multiplied no further.
    """
    if a.shape[1] <= head or min_sim <= 0:
        return np.arange(len(a)), np.arange(len(b)), a @ b.T
    most = a[:, :head] @ b[:, :head].T
    most += np.outer(np.linalg.norm(a[:, head:], axis=1), np.linalg.norm(b[:, head:], axis=1))
    able = most >= min_sim - 1e-9
    r, c = np.flatnonzero(able.any(1)), np.flatnonzero(able.any(0))
    return r, c, a[r] @ b[c].T


def visits(faces: DataFrame, min_sim: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(id, v, home, calls): every vector's own block, and the blocks that may hold one of ``min_sim`` or more.

    Blocks gather around pivots, at most ``pivots`` of them, that are broadcast. An angle to a
    block's vector is at least the angle to its pivot less the block's radius; blocks beyond the
    angle of ``min_sim`` aren't called on.
    """
    spark = faces.sparkSession
    ship(spark)
    base = faces.select("id", F.col("embedding").alias("v"))
    n = base.count()
    some = min(pivots, -(-n // block))
    if some <= 1:
        return base.select("id", "v", F.lit(0).alias("home"), F.array(F.lit(0)).alias("calls"))
    held = base.orderBy(F.xxhash64("id"), "id").limit(some).select("v").collect()
    shared = spark.sparkContext.broadcast(_unit(np.array([r["v"] for r in held]))[0])
    angles = lambda v: np.arccos(np.clip(_unit(v.astype("float64"))[0] @ shared.value.T, -1, 1))

    def nearest(batches):
        for batch in batches:
            v = np.vstack(batch["v"]).astype("float64")
            far, norm = angles(v), np.linalg.norm(v, axis=1)
            yield pd.DataFrame({"home": far.argmin(1), "far": far.min(1), "norm": norm})

    rows = base.mapInPandas(nearest, "home int, far double, norm double").groupBy("home").agg(F.max("far").alias("far"), F.max("norm").alias("norm")).collect()  # a row a pivot
    radius, longest = {r["home"]: r["far"] for r in rows}, max(r["norm"] for r in rows)
    limit = np.arccos(min(1.0, min_sim / max(1.0, longest**2))) if min_sim > 0 else np.pi
    reach = np.array([radius.get(p, -10.0) + limit + 1e-6 for p in range(len(held))])  # nothing calls on an empty block

    def place(batches):
        for batch in batches:
            far = angles(np.vstack(batch["v"]))
            calls = [np.flatnonzero(row) for row in far <= reach]
            yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "home": far.argmin(1), "calls": calls})

    kind = base.schema["v"].dataType.simpleString()
    return written(base.mapInPandas(place, f"id long, v {kind}, home int, calls array<int>"), "knn-places")


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the same ordered fold in double as ``dot``."""
    out = np.zeros(len(a))
    for at in range(0, len(a), FOLDED):
        products = a[at : at + FOLDED].astype("float64") * b[at : at + FOLDED].astype("float64")
        for column in products.T:
            out[at : at + FOLDED] += column
    return out


def foremost(v: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Rows without those of which ``n`` copies with smaller ids are there: a copy is as near to anything."""
    order = np.argsort(ids, kind="stable")
    copy = np.unique(np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    by = np.argsort(copy, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(copy[by]) != 0]))
    place = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return np.sort(order[by[place < n]])


class Nearest:
    """The best ``k`` at ``min_sim`` or above of each held vector, among others that come in batches; ties by id.

    Products are taken in single precision, where what rounding can do is below ``slack``; only pairs that
    may still be among the best are folded exactly.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, min_sim: float):
        self.ids, self.v, self.k, self.min_sim = ids, v, k, min_sim
        self.norm = np.linalg.norm(v.astype("float64"), axis=1)
        self.fast = v.astype("float32", copy=False)
        self.sims, self.ends = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo("int64").max)
        self.split: bool | None = None  # whether leading components tell rows apart

    def see(self, ids: np.ndarray, v: np.ndarray) -> None:
        some = foremost(v, ids, self.k + 1)  # one of them may be the held vector itself
        ids, v = ids[some], v[some]
        norm = np.linalg.norm(v.astype("float64"), axis=1)
        longest = norm[np.isfinite(norm)].max(initial=0.0)
        single = max(longest, self.norm[np.isfinite(self.norm)].max(initial=0.0)) < 1e15
        w = v.astype("float32" if single else "float64", copy=False)
        for at in range(0, len(self.ids), STRIPE):
            self._stripe(at, ids, v, w, (v.shape[1] + 8) * (2.0**-23 if single else 2.0**-51) * longest, single)

    def _stripe(self, at: int, ids: np.ndarray, v: np.ndarray, w: np.ndarray, unit: float, single: bool) -> None:
        own = slice(at, at + STRIPE)
        a = self.fast[own] if single else self.v[own].astype("float64")
        slack = unit * self.norm[own] + 1e-30
        rows, cols = np.arange(len(a)), np.arange(len(w))
        if self.split is not False:
            rows, cols, most = near_pairs(a, w, self.min_sim - 2 * float(np.nanmax(slack)))
            if self.split is None:
                self.split = 2 * most.size < len(a) * len(w)
            if not most.size:
                return
        else:
            most = a @ w.T
        slack = slack[rows]
        bar = (np.maximum(self.sims[own][rows, -1], self.min_sim) - slack).astype(most.dtype)
        able = most >= bar[:, None]
        if np.count_nonzero(able) > 4 * self.k * len(rows) and most.shape[1] > self.k + 1:
            edge = np.partition(np.where(np.isnan(most), -np.inf, most), most.shape[1] - self.k - 1, axis=1)[:, most.shape[1] - self.k - 1]
            able &= most >= (edge - 2 * slack).astype(most.dtype)[:, None]
        r, c = np.nonzero(able)
        r, c = rows[r] + at, cols[c]
        other = self.ids[r] != ids[c]
        r, c = r[other], c[other]
        sims = folded_pairs(self.v, v, r, c)
        ends = ids[c]
        last, end = self.sims[r, -1], self.ends[r, -1]
        better = (sims >= self.min_sim) & ((sims > last) | ((sims == last) & (ends < end)))
        if better.any():
            self._keep(r[better], sims[better], ends[better])

    def _keep(self, r: np.ndarray, sims: np.ndarray, ends: np.ndarray) -> None:
        rows = np.unique(r)
        r, sims, ends = np.concatenate([r, np.repeat(rows, self.k)]), np.concatenate([sims, self.sims[rows].ravel()]), np.concatenate([ends, self.ends[rows].ravel()])
        order = np.lexsort((ends, -sims, r))
        start = np.searchsorted(r[order], rows)
        best = order[start[:, None] + np.arange(self.k)]
        self.sims[rows], self.ends[rows] = sims[best], ends[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.sims > -np.inf)
        return self.ids[r], self.ends[r, c], self.sims[r, c], (c + 1).astype("int32")


def folded_pairs(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The folds of rows r of one with rows c of the other, FOLDED at a time."""
    if not len(r):
        return np.zeros(0)
    return np.concatenate([folded(a[r[at : at + FOLDED]], b[c[at : at + FOLDED]]) for at in range(0, len(r), FOLDED)])


def _matrix(column: pa.ListArray) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count or (sizes != sizes[:1]).any():
        raise ValueError("vectors of one length are needed, and no null")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def knn(faces: DataFrame, k: int, min_sim: float, block: int = BLOCK, pivots: int = PIVOTS, held: int = HELD) -> DataFrame:
    """(i, j, sim, rank): every vector's best ``k`` others at ``min_sim`` or above, ties by id.

    A unit is the vectors of some blocks, or a part of a block, ``held`` at most. It takes one task: its
    own vectors come first, then all that call on its blocks stream past them. So a vector is sent
    once to each unit that it may be near, and neither pairs nor candidates are shuffled.
    """
    placed = visits(faces, min_sim, block, pivots)
    homes = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    n, tasks = sum(homes.values()), 2 * faces.sparkSession.sparkContext.defaultParallelism
    most = min(held, max(-(-n // tasks), min(held, 1024)))
    first, parts, units, room = [0] * (max(homes, default=0) + 1), [1] * (max(homes, default=0) + 1), 0, 0
    for home, own in sorted(homes.items()):
        if own <= room:  # it joins the unit before
            first[home], room = units - 1, room - own
            continue
        first[home], parts[home] = units, -(-own // most)
        units, room = units + parts[home], most - own if parts[home] == 1 else 0
    at, of = F.lit(first), F.lit(parts)
    unit = F.get(at, "home") + F.pmod(F.xxhash64("id"), F.get(of, "home"))
    called = F.flatten(F.transform(F.filter("calls", lambda c: c < len(first)), lambda c: F.sequence(F.get(at, c), F.get(at, c) + F.get(of, c) - 1)))
    own = placed.select(unit.cast("int").alias("unit"), F.lit(0).alias("turn"), "id", "v")
    callers = placed.select(F.explode(F.array_distinct(called)).alias("unit"), F.lit(1).alias("turn"), "id", "v")
    dealt = own.unionByName(callers).repartitionById(max(1, units), "unit").sortWithinPartitions("unit", "turn").select("unit", "turn", "id", "v")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["i", "j", "sim", "rank"]
        now, ids, vs, near = None, [], [], None
        for batch in batches:
            of, turn, every = (batch.column(c).to_numpy() for c in ("unit", "turn", "id"))
            v = _matrix(batch.column("v"))
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(turn) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(of)]):
                if of[lo] != now:
                    if near:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in near.found()], names)
                    now, ids, vs, near = of[lo], [], [], None
                if turn[lo] == 0:
                    ids, vs = [*ids, every[lo:hi].copy()], [*vs, v[lo:hi].copy()]
                    continue
                if near is None and ids:
                    near, ids, vs = Nearest(np.concatenate(ids), np.vstack(vs), k, min_sim), [], []
                if near:
                    near.see(every[lo:hi], v[lo:hi])
        if near:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in near.found()], names)

    return written(dealt.mapInArrow(best, "i long, j long, sim double, rank int"), "knn")


def candidate_edges(neighbours: DataFrame) -> DataFrame:
    """Neighbour pairs of either direction, each once, the smaller id first."""
    return neighbours.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("sim").alias("sim"))


def mutual_edges(neighbours: DataFrame) -> DataFrame:
    """Pairs that are neighbours in both directions: of a pair's two rows, both are there."""
    pairs = neighbours.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.max("sim").alias("sim"))
    return pairs.filter("lo <> hi").select("a", "b", "sim")


def edge_histogram(edges: DataFrame) -> DataFrame:
    bucket = F.least(F.greatest(F.floor((F.col("sim") - 0.3) / 0.05), F.lit(0)), F.lit(13))
    counts = edges.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("bar", F.repeat(F.lit("#"), F.least("n", F.lit(60)).cast("int")))


def merge_evidence(neighbours: DataFrame, groups: DataFrame, min_pairs: int) -> DataFrame:
    """(a, b, pairs, max_sim): groups with several near faces across, from directed pairs i < j.

    Neighbours in the same group have taken their places in the ranking before they are left out.
    """
    gi = groups.select(F.col("id").alias("i"), F.col("g").alias("gi"))
    gj = groups.select(F.col("id").alias("j"), F.col("g").alias("gj"))
    across = neighbours.filter("i < j").join(gi, "i").join(gj, "j").filter("gi <> gj")
    tally = across.groupBy(F.least("gi", "gj").alias("a"), F.greatest("gi", "gj").alias("b")).agg(F.count(F.lit(1)).alias("pairs"), F.max("sim").alias("max_sim"))
    return tally.filter(F.col("pairs") >= min_pairs)


def anchors(faces: DataFrame, size: int) -> DataFrame:
    """The best-scored confirmed faces of every person."""
    order = Window.partitionBy("identity_id").orderBy(F.desc("score"), "id")
    confirmed = faces.filter("confirmed = 1 and ignored = 0 and identity_id is not null")
    return confirmed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def anchor_matches(pool: DataFrame, core: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(identity_id, g, size, matched, max_sim) for every group that most of matches a person.

    A face's score is the mean of its best similarities to the person's anchors. Anchors are sent
    to the faces, ANCHORS_AT_ONCE at a time, and multiplied there; only scores that clear the bar
    come back, so that faces are never shuffled and never meet people in a join.
    """
    counts = core.groupBy("identity_id").agg(F.count(F.lit(1)).alias("n"))
    turns = counts.withColumn("turn", F.pmod(F.xxhash64("identity_id"), F.lit(max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // ANCHORS_AT_ONCE)))))
    numbers = sorted(r["turn"] for r in turns.select("turn").distinct().collect())
    faces = pool.select("id", "g", "embedding")
    hits = [_hits(faces, core.join(turns.filter(F.col("turn") == turn), "identity_id", "left_semi"), params) for turn in numbers]
    if not hits:
        hits = [faces.filter("false").select("g", F.lit(0).cast("long").alias("identity_id"), F.lit(0.0).alias("score"))]
    tally = reduce(DataFrame.unionByName, hits).groupBy("identity_id", "g").agg(F.count(F.lit(1)).alias("matched"), F.max("score").alias("max_sim"))
    sizes = faces.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    return tally.join(sizes, "g").select("identity_id", "g", "size", "matched", "max_sim").filter((2 * F.col("matched") >= F.col("size")) & (F.col("matched") >= F.greatest(F.lit(1), F.least(F.lit(2), F.col("size")))))


def _hits(faces: DataFrame, core: DataFrame, params: Params) -> DataFrame:
    """(g, identity_id, score) of every face and person, not its own, whose score is ``link`` or more."""
    held = core.select("identity_id", "id", "embedding").orderBy("identity_id", "id").toPandas()  # one turn's anchors
    if held.empty:
        return faces.filter("false").select("g", F.lit(0).cast("long").alias("identity_id"), F.lit(0.0).alias("score"))
    owners = held["identity_id"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    shared = faces.sparkSession.sparkContext.broadcast((np.vstack(held["embedding"]).astype("float64"), owners[starts], starts))
    top, bar = params.anchor_top, params.link

    def run(batches):
        mat, people_, at = shared.value
        ends = np.append(at[1:], len(mat))
        for batch in batches:
            for lo in range(0, len(batch), STRIPE):
                some = batch.iloc[lo : lo + STRIPE]
                sims = np.vstack(some["embedding"]).astype("float64") @ mat.T
                best = [-np.sort(-sims[:, a:b], axis=1)[:, :top].mean(axis=1) for a, b in zip(at, ends)]
                scores, g = np.column_stack(best), some["g"].to_numpy()
                r, c = np.nonzero((scores >= bar) & (g[:, None] != -people_[None, :]))
                yield pd.DataFrame({"g": g[r], "identity_id": people_[c], "score": scores[r, c]})

    return faces.mapInPandas(run, "g long, identity_id long, score double")


def mean_normalized(faces: DataFrame, key: str) -> DataFrame:
    """The unit mean vector of each group, summed in id order."""
    packed = faces.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "embedding"))), lambda s: F.transform(s["embedding"], lambda x: x.cast("double"))).alias("vs"))
    total = F.aggregate(F.slice("vs", 2, F.size("vs")), F.get("vs", F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return packed.select(key, normalized(total).alias("mean"))



"""Map markers: a hierarchy of greedy radius clusters, one level a zoom.

Coordinates are whole Web-Mercator units, a quarter of a pixel at the deepest zoom, so sums,
centres and distances are exact. Photos of one place are one node from the start; a cell of the
deepest level then has a bounded number of nodes however many photos there are.

A level goes through its nodes in id order: a node that is still free takes all free ones within
the radius. So a node founds a cluster if and only if no smaller founder is near it, and belongs
to the smallest founder near it. Founders are found in rounds: each task walks a block of cells
and its halo and decides what hangs on nothing undecided beyond the block; owners are then a
join over cells.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.scratch import written

#: The radius in pixels, a tile's pixels, the deepest clustered zoom.
RADIUS, EXTENT, MAX_ZOOM = 64, 512, 17
#: Units around the world.
WORLD = 1 << 28
#: Cells along a block's side; nodes that one task may hold for all zooms left.
SIDE, SMALL = 8, 10_000

FREE, FOUNDER, TAKEN = 0, 1, 2
NODE = "id long, n long, sx long, sy long"


def reach(zoom: int) -> int:
    """The radius of a zoom in units."""
    return WORLD * RADIUS // EXTENT >> zoom


def units(lat: Column, lon: Column) -> tuple[Column, Column]:
    inside = lambda v: F.least(F.greatest(F.floor(v * WORLD), F.lit(0)), F.lit(WORLD - 1)).cast("long")
    sin = F.sin(F.radians(F.greatest(F.least(lat, F.lit(85.0511)), F.lit(-85.0511))))
    return inside(lon / 360 + 0.5), inside(0.5 - F.log((1 + sin) / (1 - sin)) / (4 * 3.141592653589793))


def degrees(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan(F.sinh(3.141592653589793 * (1 - 2 * y / WORLD)))), x / WORLD * 360 - 180


def settle(ids: list[int], xs: list[int], ys: list[int], state: list[int], own: list[bool], r: int, block: list | None = None) -> list[int]:
    """States after a walk in id order; a free node stays so if a smaller one near it does.

    Nodes that aren't ``own`` are a halo: what is known of them counts, but nothing is decided.
    Nodes of different ``block`` don't meet.
    """
    founders, open_ = defaultdict(list), defaultdict(list)
    state, block = list(state), block or [0] * len(ids)
    cells = [(k, x // r, y // r) for k, x, y in zip(block, xs, ys)]
    for i in np.flatnonzero(np.array(state) == FOUNDER).tolist():
        founders[cells[i]].append((ids[i], xs[i], ys[i]))
    shared = Counter(cells)
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        if state[i] != FREE:
            continue
        x, y, f, (k, cx, cy) = xs[i], ys[i], ids[i], cells[i]
        near = [c for c in ((k, cx + a, cy + b) for a, b in around) if c in shared]
        if any(g < f and (x - p) ** 2 + (y - q) ** 2 <= r * r for c in near for g, p, q in founders.get(c, ())):
            state[i] = TAKEN
        elif not own[i] or any((x - p) ** 2 + (y - q) ** 2 <= r * r for c in near for p, q in open_.get(c, ())):
            open_[cells[i]].append((x, y))
        else:
            state[i] = FOUNDER
            founders[cells[i]].append((f, x, y))
    return state


def _founders(nodes: DataFrame, r: int, side: int) -> DataFrame:
    """(id, x, y, state) of nodes (id, x, y), in rounds until every node is a founder or taken."""
    left = nodes.select("id", "x", "y", F.lit(FREE).alias("state"))

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole blocks as they come, sorted by block; the last one of a batch waits for its rest."""
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            last = held[["bx", "by"]].iloc[-1]
            open_ = (held["bx"] == last["bx"]) & (held["by"] == last["by"])
            yield decided(held[~open_])
            held = held[open_]
        if held is not None:
            yield decided(held)

    def decided(rows: pd.DataFrame) -> pd.DataFrame:
        columns = [rows[c].tolist() for c in ("id", "x", "y", "state", "own")]
        state = settle(*columns, r, list(zip(rows["bx"].tolist(), rows["by"].tolist())))
        return rows.assign(state=state).loc[rows["own"], ["id", "x", "y", "state"]]

    while True:
        cell = lambda name, step: F.floor((F.floor(F.col(name) / r) + step) / side)
        blocks = F.array_distinct(F.array(*[F.struct(cell("x", a).alias("bx"), cell("y", b).alias("by")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        held = left.withColumn("home", F.struct(cell("x", 0).alias("bx"), cell("y", 0).alias("by"))).withColumn("block", F.explode(blocks))
        halo = held.select("id", "x", "y", "state", (F.col("home") == F.col("block")).alias("own"), "block.bx", "block.by")
        dealt = halo.repartition("bx", "by").sortWithinPartitions("bx", "by")
        left = written(dealt.mapInPandas(walk, "id long, x long, y long, state int"), "map-states")
        if not left.filter(F.col("state") == FREE).take(1):
            return left


def owners(nodes: DataFrame, zoom: int, side: int = SIDE) -> DataFrame:
    """Nodes with ``up``, the smallest founder of the zoom within the radius."""
    r = reach(zoom)
    placed = nodes.withColumns({"x": F.expr("sx div n"), "y": F.expr("sy div n")})
    cells = lambda step_x, step_y: [F.floor(F.col("x") / r) + step_x, F.floor(F.col("y") / r) + step_y]
    found = _founders(placed, r, side).filter(F.col("state") == FOUNDER)
    near = F.array(*[F.struct(cells(a, b)[0].alias("cx"), cells(a, b)[1].alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = found.select(F.col("id").alias("up"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.explode(near).alias("c")).select("up", "fx", "fy", "c.cx", "c.cy")
    within = (F.col("x") - F.col("fx")) * (F.col("x") - F.col("fx")) + (F.col("y") - F.col("fy")) * (F.col("y") - F.col("fy")) <= r * r
    met = placed.withColumns(dict(zip(("cx", "cy"), cells(0, 0)))).join(near, ["cx", "cy"]).filter(within)
    return met.groupBy("id", "n", "sx", "sy").agg(F.min("up").alias("up"))


def _rest(nodes: DataFrame, zoom: int) -> DataFrame:
    """All levels from ``zoom`` on, in one task: the caller has counted the nodes."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(batches) or [pd.DataFrame({"id": [], "n": [], "sx": [], "sy": []}, dtype="int64")])
        for z in range(zoom, -2, -1):
            if z >= 0 and len(held):
                r, x, y = reach(z), (held["sx"] // held["n"]).tolist(), (held["sy"] // held["n"]).tolist()
                ids = held["id"].tolist()
                state = settle(ids, x, y, [FREE] * len(ids), [True] * len(ids), r)
                heads = defaultdict(list)
                for i in np.flatnonzero(np.array(state) == FOUNDER):
                    heads[x[i] // r, y[i] // r].append((ids[i], x[i], y[i]))
                near = lambda p, q: (h for a in (-1, 0, 1) for b in (-1, 0, 1) for h, s, t in heads.get((p // r + a, q // r + b), ()) if (p - s) ** 2 + (q - t) ** 2 <= r * r)
                held["up"] = pd.array([min(near(p, q)) for p, q in zip(x, y)], dtype="Int64")
            else:
                held["up"] = pd.array([None] * len(held), dtype="Int64")
            if z < zoom or zoom < MAX_ZOOM:
                yield held.assign(zoom=z + 1)[["zoom", "id", "n", "sx", "sy", "up"]]
            if z >= 0 and len(held):
                held = held.groupby("up", as_index=False)[["n", "sx", "sy"]].sum().rename(columns={"up": "id"}).astype("int64")

    return nodes.coalesce(1).mapInPandas(run, f"zoom int, {NODE}, up long")


def levels(points: DataFrame, small: int = SMALL, side: int = SIDE) -> DataFrame:
    """(zoom, id, n, x, y, up) of the clusters of every zoom over points (id, lat, lon).

    ``id`` is the smallest photo of a cluster, which is its cover; ``up`` is the cluster one zoom
    out that holds it, null at zoom 0. Points without a position are left out.
    """
    x, y = units(F.col("lat"), F.col("lon"))
    placed = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select("id", x.alias("x"), y.alias("y"))
    nodes = placed.groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = written(nodes.select("id", "n", (F.col("x") * F.col("n")).alias("sx"), (F.col("y") * F.col("n")).alias("sy")), "map-nodes")
    out: DataFrame | None = None
    add = lambda more: more if out is None else out.unionByName(more)
    for zoom in range(MAX_ZOOM, -1, -1):
        if nodes.count() <= small:
            out = add(_rest(nodes, zoom))
            break
        owned = written(owners(nodes, zoom, side), "map-owners")
        if zoom < MAX_ZOOM:
            out = add(owned.select(F.lit(zoom + 1).alias("zoom"), "id", "n", "sx", "sy", "up"))
        nodes = owned.groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy")])
    else:
        out = add(nodes.select(F.lit(0).alias("zoom"), "id", "n", "sx", "sy", F.lit(None).cast("long").alias("up")))
    return written(out.select("zoom", "id", "n", F.expr("sx div n").alias("x"), F.expr("sy div n").alias("y"), "up"), "map-levels")


def markers(levels_: DataFrame, zoom: int, box: tuple[float, float, float, float] | None = None, limit: int | None = None) -> DataFrame:
    """(zoom, cover, n, x, y, lat, lon, badge, expansion): a zoom's clusters, largest first where limited.

    ``box`` is (west, south, east, north) in degrees. ``expansion`` is the zoom at which a cluster
    comes apart, no deeper than the deepest; null for a single place's photo.
    """
    zoom = max(0, min(zoom, MAX_ZOOM))
    # A cluster is the same one at all zooms at which its founder holds as many.
    whole = levels_.groupBy("id", "n").agg(F.max("zoom").alias("last"))
    lat, lon = degrees(F.col("x"), F.col("y"))
    at = levels_.filter(F.col("zoom") == zoom).join(whole, ["id", "n"])
    shown = at.select("zoom", F.col("id").alias("cover"), "n", "x", "y", lat.alias("lat"), lon.alias("lon"), S.count_badge(F.col("n")).alias("badge"), F.when(F.col("n") > 1, F.least(F.col("last") + 1, F.lit(MAX_ZOOM))).alias("expansion"))
    if box:
        west, south, east, north = box
        across = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
        shown = shown.filter(across & F.col("lat").between(south, north))
    return shown.orderBy(F.desc("n"), "cover").limit(limit) if limit else shown

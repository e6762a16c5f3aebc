"""Map levels against a plain loop in id order."""

import random

import pytest
from pyspark.sql import functions as F

from heliograph.operators import maps


def plain(points):
    """(zoom, id, n, x, y, up) of points (id, x, y): every level goes through its nodes in id order."""
    nodes, out = {}, []
    for i, x, y in sorted(points):
        same = next((k for k, (p, q, n, sx, sy) in nodes.items() if (p, q) == (x, y)), i)
        p, q, n, sx, sy = nodes.get(same, (x, y, 0, 0, 0))
        nodes[same] = (x, y, n + 1, sx + x, sy + y)
    for zoom in range(17, -1, -1):
        r, free, made, up = maps.reach(zoom), sorted(nodes), {}, {}
        while free:
            head, *free = free
            x, y = nodes[head][:2]
            near = [i for i in free if (nodes[i][0] - x) ** 2 + (nodes[i][1] - y) ** 2 <= r * r]
            free = [i for i in free if i not in near]
            n, sx, sy = (sum(nodes[i][k] for i in [head, *near]) for k in (2, 3, 4))
            made[head] = (sx // n, sy // n, n, sx, sy)
            up |= {i: head for i in [head, *near]}
        if zoom < 17:
            out += [(zoom + 1, i, nodes[i][2], nodes[i][0], nodes[i][1], up[i]) for i in nodes]
        nodes = made
    return sorted(out + [(0, i, n, x, y, None) for i, (x, y, n, _, _) in nodes.items()], key=repr)


def scattered(seed, n=160):
    rng = random.Random(seed)
    towns = [(rng.uniform(-80, 80), rng.uniform(-180, 180), 10 ** rng.uniform(-4, 0.7)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), n):
        lat, lon, wide = rng.choice(towns)
        rows.append((i, lat + rng.gauss(0, wide), (lon + rng.gauss(0, wide) + 180) % 360 - 180))
    walk = [(2000 + i, 10 + i * 0.0002, 20 + i * 0.0001) for i in range(16)]  # ids that grow along a road
    return rows + walk + [(i + 3000, lat, lon) for i, lat, lon in rows[:20]]


@pytest.mark.parametrize("seed,small,side", [(1, 50_000, 8), (2, 195, 8)])
def test_levels_equal_a_plain_loop(spark, seed, small, side):
    points = spark.createDataFrame([*scattered(seed), (9999, None, 3.0)], "id long, lat double, lon double")
    x, y = maps.units(F.col("lat"), F.col("lon"))
    want = plain([tuple(r) for r in points.filter("lat is not null").select("id", x, y).collect()])
    found = maps.levels(points, small, side)
    assert sorted((tuple(r) for r in found.select("zoom", "id", "n", "x", "y", "up").collect()), key=repr) == want


@pytest.mark.parametrize("zoom,side", [(17, 4), (2, 1)])
def test_founders_in_rounds(spark, zoom, side):
    """Blocks so small that decisions wait for each other."""
    points = spark.createDataFrame(scattered(4, 60), "id long, lat double, lon double")
    x, y = maps.units(F.col("lat"), F.col("lon"))
    nodes = points.groupBy(x.alias("x"), y.alias("y")).agg(F.min("id").alias("id")).select("id", F.lit(1).cast("long").alias("n"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    rows, up, r = sorted(tuple(n) for n in nodes.collect()), {}, maps.reach(zoom)
    for i, _, px, py in rows:
        heads = [h for h, _, hx, hy in rows if up.get(h) == h and (hx - px) ** 2 + (hy - py) ** 2 <= r * r]
        up[i] = min(heads, default=i)
    assert {n["id"]: n["up"] for n in maps.owners(nodes, zoom, side).collect()} == up


def test_markers_expand_where_they_come_apart(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.01), (4, 40.0, 100.0)], "id long, lat double, lon double")
    found = maps.levels(points)
    last = {r["cover"]: r for r in maps.markers(found, 17).collect()}
    assert {k: r["n"] for k, r in last.items()} == {1: 2, 3: 1, 4: 1} and last[1]["expansion"] == 17 and last[4]["expansion"] is None
    far = {r["cover"]: r for r in maps.markers(found, 5).collect()}
    assert {k: r["n"] for k, r in far.items()} == {1: 3, 4: 1}
    split = far[1]["expansion"]
    assert {r["cover"] for r in maps.markers(found, split).collect()} == {1, 3, 4} and {r["cover"] for r in maps.markers(found, split - 1).collect()} == {1, 4}
    assert [r["cover"] for r in maps.markers(found, 5, (90, 30, 110, 50)).collect()] == [4] and [r["cover"] for r in maps.markers(found, 99, limit=1).collect()] == [1]
    assert abs(last[4]["lat"] - 40) < 1e-4 and abs(last[4]["lon"] - 100) < 1e-4
    assert maps.levels(points.limit(0)).count() == 0

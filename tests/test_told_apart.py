"""Pairs of people of different names, met block by block, against all pairs."""

import pytest

from heliograph.operators import people

NAMES = ["Mía", "Omar", None, "Kevin"]


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_equal_all_pairs(spark, block):
    rows = [(i * 7 % 40, NAMES[i % 4]) for i in range(40)] + [(3, "Kevin"), (3, "Omar"), (8, "Mía"), (8, "Mía")]
    told = [(1, 2), (2, 1), (5, 5), (3, 3), (0, 4), (4, 8), (90, 91), (2, 90), (6, 26)]
    identities = spark.createDataFrame(rows, "id long, name string")
    explicit = spark.createDataFrame(told, "a long, b long")
    named = [r for r in rows if r[1] is not None]
    every = sorted((x, y) for x, p in named for y, q in named if x < y and p != q)
    assert sorted(map(tuple, people.implicit_cannot_links(identities, block).collect())) == every
    got = sorted(map(tuple, people.cannot_links(explicit, identities, block).collect()))
    assert got == sorted(set(every) | {(min(p), max(p)) for p in told})


def test_no_pair_is_shuffled(spark):
    identities = spark.createDataFrame([(i, NAMES[i % 4]) for i in range(50)], "id long, name string")
    found = people.cannot_links(spark.createDataFrame([(1, 2)], "a long, b long"), identities, 8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "Repartition" not in above


def test_nobody(spark):
    identities = spark.createDataFrame([(1, None)], "id long, name string")
    assert people.implicit_cannot_links(identities).count() == 0
    assert [tuple(r) for r in people.cannot_links(spark.createDataFrame([(2, 1)], "a long, b long"), identities).collect()] == [(1, 2)]

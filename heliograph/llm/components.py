"""Connected components of an edge table that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.storage import drop, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (a, b).

    Large-star and small-star rounds until nothing changes. Each round's edges are written to
    shared storage. A round needs minima by node and a join, both of which take a node with very
    many edges apart: minima are pre-aggregated and written, so that the join can be split.
    """
    tidy = lambda e: e.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(tidy(edges), "edges")
    if not now.take(1):
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(tidy(large), "edges")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        following = materialize(tidy(small), "edges")
        for done in (now, large, least, low):
            drop(done)
        seen = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = following
        if seen == state:
            break
        state = seen
    # Every edge now leads to its component's smallest id.
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", F.col("b").alias("component")).distinct())

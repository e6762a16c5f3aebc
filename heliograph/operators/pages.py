"""Random access to a long ordering: range partitions with counts before them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import scalars as S
from heliograph.scratch import folder, written

#: Rows in a partition, about; a page reads the one or two that hold it.
ROWS = 100_000


@dataclass(frozen=True)
class PageIndex:
    """Rows in folders of consecutive ranges, and how many rows come before each."""

    path: str
    schema: str
    parts: DataFrame
    order: tuple[str, ...]


def _keys(order: tuple[str, ...]) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def build(rows: DataFrame, *order: str, per_part: int = ROWS) -> PageIndex:
    """An index of ``rows`` by unique keys, each ascending or, with ``-`` before it, descending."""
    spark = rows.sparkSession
    kept = written(rows, "page-rows")
    dealt = kept.repartitionByRange(max(1, -(-kept.count() // per_part)), *_keys(order)).withColumn("part", F.spark_partition_id())
    path = f"{folder(spark)}/heliograph/pages-{uuid.uuid4().hex}"
    dealt.sortWithinPartitions(*_keys(order)).write.mode("overwrite").partitionBy("part").parquet(path)
    sizes = spark.read.schema(f"{rows.schema.toDDL()}, part int").parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    return PageIndex(path, rows.schema.toDDL(), written(sizes.select("part", "n", before.alias("before")), "page-parts"), order)


def page(index: PageIndex, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the ordering, from the parts that hold them."""
    spark = index.parts.sparkSession
    holding = index.parts.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).collect()  # those of one page
    if not holding:
        return spark.createDataFrame([], index.schema)
    held = spark.read.option("basePath", index.path).schema(f"{index.schema}, part int").parquet(*[f"{index.path}/part={r['part']}" for r in holding])
    start = F.create_map(*[F.lit(v) for r in holding for v in (r["part"], r["before"])])
    place = F.row_number().over(Window.partitionBy("part").orderBy(*_keys(index.order))) - 1 + F.element_at(start, F.col("part"))
    return held.withColumn("place", place).filter(F.col("place").between(offset, offset + limit - 1)).drop("part", "place")


def timeline(photos: DataFrame, by_date: bool = True, per_part: int = ROWS) -> PageIndex:
    """The index of a view, newest first or in discovery order."""
    rows = photos.select("id", "thumb_status", S.sort_ts().alias("ts"), (F.col("favorite") != 0).alias("favorite"))
    return build(rows, *(("-ts", "-id") if by_date else ("id",)), per_part=per_part)

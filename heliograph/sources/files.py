"""Curation files and table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, favorite boolean, hidden boolean"


def read_curation(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a version-1 curation document: {version, entries: [{path, favorite, hidden}]}."""
    whole = spark.read.schema(f"version int, entries array<struct<{ENTRY.replace(' string', ':string').replace(' boolean', ':boolean')}>>").json(path, multiLine=True)
    return whole.filter("version = 1").select(F.explode("entries").alias("e")).select("e.*")


def curation_document(rows: DataFrame) -> DataFrame:
    """The same document from (path, favorite, hidden) rows, as one JSON text; curated rows are few."""
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("path", "favorite", "hidden"))).alias("entries"))
    return listed.select(F.to_json(F.struct(F.lit(1).alias("version"), "entries"), {"pretty": "true"}).alias("value"))


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """A consistent copy of tables, before a reset."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def with_defaults(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns that an older table lacks, with their defaults; present ones stay."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (t, v) in columns.items() if c not in df.columns})

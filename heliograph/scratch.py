"""Written tables that cut lineage, and this package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="heliograph-library-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one of its own only where none is set and one machine runs all."""
    where = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="heliograph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that a lost executor costs a re-read; its shuffle files go then."""
    spark = df.sparkSession
    ship(spark)
    path = f"{folder(spark)}/heliograph/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(cleanup, was)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    for where in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        if path.getParent().getName() == "heliograph":
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

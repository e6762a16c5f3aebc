"""N-gram Jaccard join of documents over signature trees."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.similar import partition_keys, similar_components
from heliograph.llm.storage import fresh_names, materialize
from heliograph.llm.substring_dedup import numbered

SIZE = 3
NUM, DEN = 90, 100


def jaccard_components(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two documents link when den * intersection >= num * union of their sets of ``size``-word
    shingles; a document of fewer words has one shingle of them all, and one without words, or a
    null, links with nothing. component_id is the smallest doc_id reachable. No link between
    different sets is lost: candidate keys are exact. Sets are held as 64-bit hashes. Repeated
    rows keep a row each, and rows of one doc_id with different texts are documents of their own;
    a null doc_id keeps null; an empty table gives no rows.
    """
    keys = partial(partition_keys, num=num, den=den)
    docs = docs.select("doc_id", "text")
    told = ["doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")]
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if not repeated.take(1):
        return similar_components(docs.select(F.col("doc_id").alias("id"), "text"), size, num, den, keys).withColumnRenamed("id", "doc_id").select(*told)
    rows = numbered(docs, "row")
    found = materialize(similar_components(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("id"), "text"), size, num, den, keys), "row-components")
    placed = rows.select(F.col("row").alias("id"), "doc_id").join(found, "id").withColumnRenamed("component", "group")
    least = materialize(placed.groupBy("group").agg(F.min("doc_id").alias("component")), "group-ids")
    unnamed = found.filter("id IS NULL").select(F.col("id").alias("doc_id"), "n", "component")
    return placed.join(least, "group").select("doc_id", "n", "component").unionByName(unnamed).select(*told)


def keep_one(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of ``docs`` for each component, the first by doc_id.

    Every row counts for itself: of repeated rows of one doc_id, and of rows without a doc_id that
    are alike, one stays. Rows without a doc_id come after all others, and ties are settled in
    order of reading. Rows without words are linked with nothing and all stay.
    """
    number, = fresh_names(docs.columns, "row_number")
    rows = numbered(docs, number)
    own = rows.select(F.col(number).alias("id"), "doc_id", "text")
    keys = partial(partition_keys, num=num, den=den)
    found = similar_components(own.select("id", "text"), size, num, den, keys)
    placed = own.select("id", "doc_id").join(found.select("id", "component"), "id")
    placed = placed.select("id", "component", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "id").alias("place"))
    first = materialize(placed.groupBy("component").agg(F.min("place").alias("first")), "group-firsts")
    later = placed.join(first, "component").filter(F.col("id") != F.col("first.id")).select(F.col("id").alias(number))
    return rows.join(later, number, "left_anti").select(*docs.columns)

"""Stand-ins for the library's tables, derived from the test tables on both engines alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHOTOS = """
SELECT d.doc_id AS id,
 concat('/lib/', d.source, '/', CASE d.doc_id % 7 WHEN 0 THEN 'Ángel fiesta' WHEN 1 THEN 'Iceland trip' WHEN 2 THEN 'Downloads' WHEN 3 THEN 'Beach' WHEN 4 THEN 'Backup (2)' WHEN 5 THEN '.cache' ELSE 'Niño 100%_off' END,
   '/IMG_', CAST(d.doc_id AS {S}), '.', CASE d.doc_id % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'png' WHEN 3 THEN 'webp' WHEN 4 THEN 'heic' ELSE 'txt' END) AS path,
 946684800 + (d.doc_id * 86413) % 788918400 AS mtime,
 d.n_chars AS size,
 CASE d.doc_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 1 END AS thumb_status,
 CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 946684800 + (d.doc_id * 28563833) % 788918400 END AS taken_ts,
 CASE WHEN d.doc_id % 4 = 0 THEN 1 ELSE 2 END AS seen,
 CASE WHEN d.doc_id % 10 >= 4 THEN 1 ELSE 0 END AS faces_scanned,
 CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE CAST((d.doc_id * 37) % 17000 AS DOUBLE) / 100 - 85 END AS lat,
 CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE CAST((d.doc_id * 91) % 36000 AS DOUBLE) / 100 - 180 END AS lon,
 CASE WHEN l.quality = 1 AND d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS favorite,
 CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS hidden,
 CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 19 = 0 THEN '' ELSE {H} END AS content_hash
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

FACES = """
SELECT vec_id AS id, CAST(floor(CAST(vec_id * 2 AS DOUBLE) / 5) AS BIGINT) AS photo_id,
 CAST(vec_id % 8 AS DOUBLE) / 10 AS x1, CAST(vec_id % 5 AS DOUBLE) / 10 AS y1,
 CAST(vec_id % 8 AS DOUBLE) / 10 + 0.2e0 AS x2, CAST(vec_id % 5 AS DOUBLE) / 10 + 0.3e0 AS y2,
 CAST(600 + (vec_id * 37) % 400 AS DOUBLE) / 1000 AS score,
 CAST(label * 10 + vec_id % 10 + 1 AS BIGINT) AS cluster_id,
 CASE WHEN label < 5 AND vec_id % 10 < 4 THEN CAST(label + 1 AS BIGINT) END AS identity_id,
 CASE WHEN label < 5 AND vec_id % 10 < 4 AND vec_id % 3 > 0 THEN 1 ELSE 0 END AS confirmed,
 CASE WHEN vec_id % 23 = 0 THEN 1 ELSE 0 END AS ignored, embedding
FROM embeddings"""

#: People by the hundred, many of one name, and pairs of them that someone told apart.
NAMED = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN concat('Ál ', n_name) ELSE n_name END AS name
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey"""
APART = "SELECT DISTINCT least(s_suppkey, s_suppkey * 7 % 50) AS a, greatest(s_suppkey, s_suppkey * 7 % 50) AS b FROM {supplier} WHERE s_suppkey % 4 = 1 AND s_suppkey <> s_suppkey * 7 % 50"

IDENTITIES = [(1, "Mía"), (2, "Ángel"), (3, "Omar"), (4, "Kevin"), (5, None)]
CANNOT_LINK = [(1, 2), (3, 4)]


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def duck(sql: str) -> str:
    """An oracle over the stand-ins: DuckDB SQL with their CTEs in front."""
    ctes = {
        "photos": PHOTOS.format(S="VARCHAR", H="sha256(d.text)"),
        "faces": FACES,
        "crowd": NAMED.format(supplier="supplier", nation="nation"),
        "apart": APART.format(supplier="supplier"),
        "identities": _values(IDENTITIES, "id, name"),
        "cannot_link": _values(CANNOT_LINK, "a, b"),
        "pool": "SELECT *, coalesce(-identity_id, cluster_id) AS g FROM faces WHERE cluster_id IS NOT NULL AND ignored = 0",
    }
    head = next((h for h in ("WITH RECURSIVE ", "WITH ") if sql.startswith(h)), "")
    return (head or "WITH ") + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items()) + (", " if head else "\n") + sql.removeprefix(head)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents")
    return spark.sql(PHOTOS.format(S="STRING", H="sha2(d.text, 256)").replace("FROM documents d LEFT JOIN labels l", "FROM {documents} d LEFT JOIN {labels} l"), documents=docs, labels=labels)


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FACES.replace("FROM embeddings", "FROM {embeddings}"), embeddings=table(spark, sf_dir, "embeddings"))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NAMED, supplier=table(spark, sf_dir, "supplier"), nation=table(spark, sf_dir, "nation"))


def apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(APART, supplier=table(spark, sf_dir, "supplier"))


def identities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IDENTITIES, "id long, name string")


def cannot_link(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANNOT_LINK, "a long, b long")


def roots(photo_rows: DataFrame) -> DataFrame:
    """Every source folder, and one nested folder."""
    spark = photo_rows.sparkSession
    own = photo_rows.select(F.concat(F.lit("/lib/"), F.element_at(F.split("path", "/"), 3)).alias("path")).distinct()
    return own.union(spark.createDataFrame([("/lib/src1/Beach",)], "path string"))

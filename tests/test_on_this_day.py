"""On this day by year, against its SQL, where a day has more photos than the day's list shows and ids are long."""

import datetime as dt

import duckdb

from heliograph.plans import catalogue

STEP, SPAN, BASE = 28563833, 788918400, 946684800


def test_every_photo_of_the_day_counts(spark, tmp_path):
    day = int(dt.datetime(2010, 6, 15, 12, tzinfo=dt.UTC).timestamp())
    at = lambda ts: (ts - BASE) * pow(STEP, -1, SPAN) % SPAN  # noqa: E731  # the id of a photo taken then
    ids = [i for s in range(520) if (i := at(day + s)) % 5] + [i for s in range(10) if (i := at(day - 365 * 86400 + s)) % 5]
    assert len(ids) > 350 and max(ids) > 1_000_000
    docs = spark.createDataFrame([(i, "a", "src1", 1) for i in ids], "doc_id long, text string, source string, n_chars int")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for t, columns in {"embeddings": "0::BIGINT AS vec_id, [1.0::FLOAT] AS embedding, 0 AS label", "supplier": "0 AS s_suppkey, 0 AS s_nationkey", "nation": "0 AS n_nationkey, 'x' AS n_name"}.items():
        con.execute(f"create view {t} as select {columns}")
    names = ("year", "photos", "cover", "badge")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalogue.ORACLES['on_this_day_by_year']})").fetchall()
    got = [tuple(r[n] for n in names) for r in catalogue.QUERIES["on_this_day_by_year"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(r[1] for r in got) == len(ids)
    newest = max((i for i in ids), key=lambda i: BASE + i * STEP % SPAN)
    assert {r[0]: r[2] for r in got}[2010] == newest

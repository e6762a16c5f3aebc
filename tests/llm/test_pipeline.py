"""The pipeline's stages, one by one and together, and the registered queries."""

import corpus_pipeline
from brute import components, decontaminate, shingles

import __spark_entry__
from heliograph.llm import language_id


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    one = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert one.columns == names and one.count() >= 0.97 * docs.count()
    two = corpus_pipeline.materialize(corpus_pipeline.dedup_lines(spark, one, sf_dir), "t")
    assert two.columns == names and two.filter("n_chars <> length(text)").count() == 0
    three = corpus_pipeline.materialize(corpus_pipeline.join_ngrams(spark, two, sf_dir), "t")
    rows = {r["doc_id"]: r["text"] for r in two.collect()}
    label = components({d: shingles(t) for d, t in rows.items()})
    assert {r["doc_id"] for r in three.collect()} == set(label.values())
    four = corpus_pipeline.materialize(corpus_pipeline.decontaminate(spark, three, sf_dir), "t")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in decontaminate([(d, rows[d]) for d in set(label.values())], items) if r[5]}
    assert bad and {r["doc_id"] for r in four.collect()} == set(label.values()) - bad
    five = corpus_pipeline.pack(spark, four, sf_dir)
    assert {r["doc_id"] for r in five.select("doc_id").collect()} == {r["doc_id"] for r in four.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == sorted(map(tuple, five.drop("sequence_id", "offset").collect()))


def test_extra_columns_survive(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).selectExpr("*", "1 AS rejected", "'x' AS lang_pred", "2 AS n_lines", "3 AS row")
    model = language_id.fit(docs)
    assert set(language_id.identify(docs, model).columns) >= set(docs.columns)


def test_stages_keep_the_values_of_columns_with_their_names(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    docs = base.selectExpr("*", "doc_id * 2 AS Rejected", "'x' AS lang_pred", "7.5 AS score", "42 AS n_lines", "doc_id + 1 AS N_Removed", "1 AS _Rejected")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.dedup_lines):
        left = stage(spark, docs, sf_dir)
        assert left.columns == docs.columns and left.count() > 100
        assert left.filter("Rejected <> doc_id * 2 or lang_pred <> 'x' or score <> 7.5 or n_lines <> 42 or N_Removed <> doc_id + 1 or _Rejected <> 1").count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id int, _gone int, tag string, left int, row long, _row int, component int"
ENGLISH = "the quick brown fox and the lazy dog went to the river in the morning and it was cold"


def rows_of(spark, texts):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 2, "t", 3, 4, 5, 6) for d, t in texts], COLUMNS)


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty, very long and repeated rows, rows without a doc_id, clashing names, and empty tables."""
    long = " ".join(f"w{i}" for i in range(30000))
    odd = rows_of(spark, [(1, ENGLISH), (1, ENGLISH), (1, ENGLISH + " indeed it was"), (None, ENGLISH), (2, None), (3, ""), (4, " \n "), (5, long), (None, None), (6, "one line\n" + ENGLISH)])
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").first()["text"]
    texts = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect() if r["text"])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf_dir)
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
        if name != "packing":
            assert got.columns == odd.columns, name
        if name == "line_dedup":  # the row without a doc_id comes first, so that all others lose the line
            assert texts(got) == [("4", " \n "), ("5", long), ("6", "one line"), ("None", ENGLISH)]
            assert sum(r["text"] == "" for r in got.collect()) == 1 and sum(r["text"] is None for r in got.collect()) == 2
        if name == "ngram_join":
            assert [d for d, t in texts(got) if t == ENGLISH] == ["1"] and got.count() == 8
        if name == "decontamination":
            assert got.count() == odd.count()
            more = odd.unionByName(rows_of(spark, [(1, f"before {benchmark} after")]))
            assert texts(stage(spark, more, sf_dir)) == texts(odd)  # only the row that holds it goes
        if name == "packing":
            assert got.count() >= odd.count()


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= names

"""Which rows the n-gram join's stage keeps where doc_ids repeat or are missing."""

from heliograph.llm import ngram_join


def test_repeated_rows_and_rows_without_doc_id(spark):
    docs = [(3, "a b c d e"), (3, "a b c d e"), (2, "A b  c d e"), (4, "p q r s"), (4, "p q r s"), (None, "a b c d e"), (None, "k l m n"), (None, "k l m n"), (5, ""), (6, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(2, "A b  c d e"), (4, "p q r s"), (None, "k l m n"), (5, ""), (6, None)], key=str)


def test_rows_of_one_id_keep_a_row_each(spark):
    """Different texts of one id are documents of their own; no row comes twice, none is lost."""
    rows = [(1, "a b c d e"), (1, "x y z w v u t"), (2, "q r s a b c"), (3, "x y z w v u t"), (4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (5, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, 3, 1), (1, 5, 1), (2, 4, 2), (3, 5, 1), (4, 3, 1), (4, 3, 1), (None, 3, None), (5, 0, 5)], key=repr)

"""The strongest pairs are taken once, not searched for anew by everything that reads them."""

from heliograph.plans import catalogue


def test_merge_suggestions_read_no_neighbours(spark, sf_dir):
    files = catalogue.QUERIES["merge_suggestions"](spark, sf_dir).inputFiles()
    assert any("/merge-top-" in f for f in files) and not any("/knn-" in f for f in files)

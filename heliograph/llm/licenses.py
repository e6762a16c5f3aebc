"""License scanning by diagonal voting.

Every rolling word k-gram of a document joins the positions that it has in license templates.
A template that stands in a document puts its grams on one diagonal (place in the document
less place in the template), so votes are counted by diagonal; diagonals next to each other,
as an inserted or a missing word makes them, are merged, and the merged span is verified by
the share of the template's words that it covers. A base phrase must stand word for word: all
of its grams on one diagonal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.storage import materialize
from heliograph.llm.words import BROADCAST_ROWS, gram_hash, small_side, words

K = 2
# Phrases that must stand word for word, and their labels.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# The method's own templates: opening or naming sentences of common licenses.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
]
#: Share of a template's words that a merged span must cover, and words that neighbours may lie apart.
COVER = 0.9
NEIGHBOURS = 2


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    base: bool


def default_templates() -> list[Template]:
    every = [(p, label, True) for p, label in BASE_PHRASES] + [(p, label, False) for p, label in TEMPLATES]
    return [Template(i, label, tuple(re.findall(r"[0-9a-z]+", p)), base) for i, (p, label, base) in enumerate(every)]


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    if short := [t.words for t in templates if len(t.words) < K]:
        raise ValueError(f"a template needs {K} words at least, as places are found by {K}-word grams: {short}")
    rows = [(t.number, t.label, t.base, len(t.words), p, list(t.words)) for t in templates for p in range(len(t.words) - K + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, base boolean, size int, place int, template_words array<string>")
    grams = grams.withColumn("hash", gram_hash("template_words", "place", K)).withColumn("gram", F.slice("template_words", F.col("place") + 1, K))
    return small_side(grams.drop("template_words"), len(rows))


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """Per row of ``docs``: n_words, base places, labels and a score, as the columns below say.

    n_base, first_word and last_word count and bound the places of base phrases; base_labels and
    labels are distinct, sorted and comma-joined ('' for none). score is the largest covered share
    of a template, 1 with a base phrase, 0 with nothing found. A null text is empty. Repeated
    rows keep a row each, an empty table gives none, and other columns are ignored. Templates of
    fewer than K words are an error.
    """
    spark = docs.sparkSession
    templates = default_templates() if templates is None else templates
    cut = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    at = cut.select("row", "doc_id", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("at", "word")).drop("word")
    hashed, grams, here = at.withColumn("hash", gram_hash("words", "at", K)), template_grams(spark, templates), F.slice("words", F.col("at") + 1, K)
    if sum(len(t.words) for t in templates) > BROADCAST_ROWS:  # a gram, and not the document's words, is shuffled then
        hashed, here = hashed.withColumn("here", F.when(F.col("at").isNotNull(), here)).drop("words"), F.col("here")
    voted = hashed.join(grams, "hash", "left")
    same = F.col("template").isNotNull() & (here == F.col("gram"))
    last = F.col("at").isNull() | (F.col("at") == F.col("n_words") - 1)
    voted = voted.withColumn("same", F.coalesce(same, F.lit(False))).filter(F.col("same") | last)
    keep = lambda name: F.when(F.col("same"), F.col(name)).alias(name)
    voted = voted.select("row", "doc_id", "n_words", "at", *map(keep, ("template", "label", "base", "size", "place")))
    voted = materialize(voted, "license-votes")

    documents = voted.filter(last).select("row", "doc_id", "n_words").distinct()
    votes = voted.filter(F.col("template").isNotNull()).withColumn("diagonal", F.col("at") - F.col("place"))
    by_diagonal = votes.groupBy("row", "template", "label", "base", "size", "diagonal").agg(F.collect_set("place").alias("places"))

    exact = by_diagonal.filter(F.col("base") & (F.size("places") == F.col("size") - K + 1))
    base = exact.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_labels")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS
    spans = by_diagonal.filter(~F.col("base")).withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    merged = spans.groupBy("row", "template", "label", "size", "span").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    verified = merged.withColumn("cover", covered / F.col("size")).filter(F.col("cover") >= COVER)
    own = verified.groupBy("row").agg(F.collect_set("label").alias("own_labels"), F.max("cover").alias("cover"))

    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.array().cast("array<string>")
    base_labels, own_labels = F.coalesce("base_labels", none), F.coalesce("own_labels", none)
    return documents.join(base, "row", "left").join(own, "row", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, own_labels)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )

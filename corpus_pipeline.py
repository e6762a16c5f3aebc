"""The corpus pipeline: five stages over ``documents``, each written and reread by the next.

Language identification drops what it rejects, line dedup takes later matching lines out, the
n-gram Jaccard join keeps one document of each group, decontamination drops documents that hold
benchmark windows, and best-fit packing lays out what is left as sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import decontamination, language_id, line_dedup, ngram_join, packing
from heliograph.llm.storage import fresh_names, materialize, table

#: No SQL engine expresses compression or tokenizers; tests compare the stages with plain Python.
ORACLE_SQL = None


def with_own_columns(docs: DataFrame, replaced: tuple[str, ...], operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operate`` leaves of ``docs``, with docs' own columns of names that it replaces brought back."""
    taken = [c for c in docs.columns if c.lower() in replaced]
    aside = dict(zip(taken, fresh_names(docs.columns, *(f"_{c}" for c in taken))))
    left = operate(docs.withColumnsRenamed(aside))
    return left.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; learned from those outside the held-out fold.

    Null texts and texts without a letter go, and so do ties. Repeated rows stay as they are.
    """
    model = language_id.fit(docs.filter(~language_id.held_out()))
    clear = lambda rows: language_id.identify(rows, model).filter(~F.col("rejected"))
    return with_own_columns(docs, ("lang_pred", "score", "rejected"), clear)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later matching lines; n_chars follows the text; emptied ones go.

    Null, empty and wordless texts stay. Repeated rows are one place and stay for the next stage.
    """
    left = with_own_columns(docs, ("n_lines", "n_removed"), lambda rows: line_dedup.dedup_lines(rows, drop_emptied=True))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by doc_id, of each group of similar ones; one of repeated rows.

    Null, empty and wordless texts are like nothing and stay. Rows without a doc_id come last.
    """
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; a null or empty text is one end token."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

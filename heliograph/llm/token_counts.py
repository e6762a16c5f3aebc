"""Token counts behind a cache keyed by content and tokenizer-version digests.

A count is looked up by the digest of the content and the digest of the vocabulary file. Only
contents that the cache lacks are encoded, each once however many documents hold it, and
their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.packing import slices
from heliograph.llm.storage import brief_shuffles, materialize, scratch_path
from heliograph.llm.tokenizers import encoder, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CACHE_SCHEMA = "content string, version string, n_tokens long"


def version_of(tokenizer: str) -> str:
    """Digest of a vocabulary file: another file or another edition never shares counts."""
    with open(tokenizer_path(tokenizer), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(misses: DataFrame, tokenizer: str) -> DataFrame:
    """Counts of (content, text) rows."""
    schema = pa.schema([("content", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in (s for b in batches for s in slices(b)):
            _, offsets = encode.encode_column(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(np.diff(offsets), pa.int64())], schema=schema)

    return misses.mapInArrow(run, "content string, n_tokens long")


def count_tokens(docs: DataFrame, cache_path: str | None = None, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    ``cache_path`` is a Parquet table of (content, version, n_tokens) in storage that all
    machines share; it is created if missing, and read whole before it is appended to. Without
    one, an empty cache of its own is used. The content is normalised by reading null as the
    empty text, and no further, as anything else would change counts. Repeated rows keep a
    row each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-cache")
    version = version_of(tokenizer)
    cache = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("version") == version)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)  # so that it can be read

    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("content"))
    # Partial aggregation leaves a row per content and task, so a text with many copies moves once a task.
    distinct = keyed.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(cache().select("content").distinct(), "content", "left_anti")
    with brief_shuffles(spark):
        _encode(misses, tokenizer).select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)

    # Two runs may have appended the same. Written, so that the join with contents of very many documents can be split.
    counts = materialize(cache().groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    sized = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("content"))
    return sized.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Language identification by compression with one raw-content dictionary per language.

Learning takes a bounded sample of labelled text per language as a zstandard dictionary. A
text is cut into blocks, every block is compressed against each dictionary, and the language
with the smallest total wins. Blocks keep a long text's own history from standing in for the
dictionary; all of the text is compressed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliograph.llm.packing import slices

UNKNOWN = "und"
#: Bytes of text that one language's dictionary holds at most, and documents it is taken from.
DICTIONARY_BYTES = 96 * 1024
SAMPLE_DOCS = 400
#: Characters of one document that a dictionary takes at most, so that no document fills it.
EXCERPT = 1000
BLOCK = 2048
#: High enough for a thorough search of the dictionary at about a third of level 13's time.
LEVEL = 9
#: A prediction is rejected when the runner-up needs less than this share more bytes.
MARGIN = 0.005


@dataclass(frozen=True)
class Model:
    dictionaries: dict[str, bytes]
    level: int = LEVEL
    block: int = BLOCK


def fit(labelled: DataFrame) -> Model:
    """Learn from (doc_id, text, lang); rows without a language or text are passed over.

    The sample is bounded by SAMPLE_DOCS excerpts and DICTIONARY_BYTES a language. It is chosen
    by a hash of doc_id, so it is spread over all rows and the same for any partitioning. A
    language's rows are counted first, so that about twice as many as are wanted meet to be ranked.
    """
    known = labelled.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.filter(F.col("text").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return Model({})
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 2 * SAMPLE_DOCS / n + 100 / n))])
    mixed = F.xxhash64(F.col("doc_id"), F.lit("language sample"))
    drawn = known.withColumn("mixed", mixed).filter(F.pmod("mixed", F.lit(1 << 30)) <= F.element_at(shares, F.col("lang")) * (1 << 30))
    rows = drawn.filter(F.col("text").rlike(r"\p{L}")).select("lang", F.pmod("mixed", F.lit(1 << 30)).alias("mixed"), F.lower(F.substring("text", 1, EXCERPT)).alias("excerpt"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("mixed", "excerpt"))
    chosen = rows.withColumn("n", first).filter(F.col("n") <= SAMPLE_DOCS).orderBy("lang", F.desc("n")).collect()
    texts: dict[str, list[str]] = {}
    for r in chosen:
        texts.setdefault(r["lang"], []).append(r["excerpt"])
    return Model({lang: "\n".join(t).encode()[-DICTIONARY_BYTES:] for lang, t in texts.items()})


class Classifier:
    def __init__(self, model: Model):
        import zstandard

        self.languages, self.block = sorted(model.dictionaries), model.block
        self.compressors = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model.level)
            self.compressors.append(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language or ``und``, score from 0 to 1, margin over the runner-up)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        raw = text.lower().encode("utf-8", "surrogatepass")  # capitals tell little
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        if len(blocks) > 1 and len(blocks[-1]) < self.block // 2:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        ranked = sorted(zip(sizes, self.languages))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, 1.0
        margin = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return ranked[0][1], min(1.0, 0.5 + 2 * margin) if margin else 0.5, margin


def identify(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """lang_pred, score and rejected for every row, beside the columns of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Columns of
    ``docs`` named lang_pred, score or rejected are replaced. Repeated rows keep a row each; an
    empty table gives no rows. Without any learned language everything is ``und``. Of languages
    with equally many bytes the first by name is predicted, with score 0.5, and rejected. Whole
    texts are compressed; EXCERPT bounds only what a dictionary takes from a document.
    """
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DICTIONARY_BYTES a language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in (s for b in batches for s in slices(b)):
            got = [classifier.predict(t) for t in batch.column("text").to_pylist()]
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays += [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == UNKNOWN or g[2] < margin for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "lang_pred", "score", "rejected"])

    kept = docs.select(*names)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"]))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0

"""Words of texts as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters, digits and non-ASCII characters, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows that a side may have to be sent to every executor.
BROADCAST_ROWS = 200_000


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text in order; a null or blank text has none."""
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def gram_hash(array: str, at: str, size: int) -> Column:
    """Hash of ``size`` elements from 0-based column ``at`` on; beyond the end it is no gram's."""
    return F.xxhash64(*[F.get(F.col(array), F.col(at) + k) for k in range(size)], F.lit(size))


def small_side(side: DataFrame, rows: int | None = None) -> DataFrame:
    """Hinted for broadcast only if it was counted to be small; else Spark shuffles or splits it."""
    n = side.count() if rows is None else rows
    return F.broadcast(side) if n <= BROADCAST_ROWS else side

"""Scalar functions as columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.plans.params import EXTENSIONS, MONTHS, READY

# Hangul syllables, which are composed by rule: the first and last, the first jamos of each kind, and how many vowels and finals.
HANGUL, LEADS, VOWELS, FINALS, N_VOWELS, N_FINALS = (0xAC00, 0xD7A3), 0x1100, 0x1161, 0x11A7, 21, 28


@cache
def fold_table() -> tuple[str, str]:
    """Characters and what is left of each without its marks; marks, which leave nothing, stand last."""
    letters, marks = {}, []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(c).startswith("M"):
            marks.append(c)
        elif (left := fold_literal(c)) != c.lower() and len(left) == 1:
            letters[c] = left
    return "".join(letters) + "".join(marks), "".join(letters.values())


def _jamos(char: Column) -> Column:
    """A Hangul syllable as its two or three jamos, any other character as it is."""
    unit = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
    at = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("long") - HANGUL[0]
    final = F.pmod(at, F.lit(N_FINALS))
    vowel = F.pmod(F.floor(at / N_FINALS), F.lit(N_VOWELS))
    jamos = F.concat(unit(F.floor(at / (N_VOWELS * N_FINALS)) + LEADS), unit(vowel + VOWELS), F.when(final > 0, unit(final + FINALS)).otherwise(""))
    return F.when(char.between(chr(HANGUL[0]), chr(HANGUL[1])), jamos).otherwise(char)


def fold(text: Column) -> Column:
    """Lower case without accents, for every script; null stays null."""
    plain = F.translate(F.lower(text), *fold_table())
    return F.when(plain.rlike(f"[{chr(HANGUL[0])}-{chr(HANGUL[1])}]"), F.array_join(F.transform(F.split(plain, ""), _jamos), "")).otherwise(plain)


@F.pandas_udf(T.StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """The same in Python: decomposed, marks dropped, lower case."""
    return text.map(lambda s: None if s is None else fold_literal(s))


def fold_literal(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")).lower()


def register(spark: SparkSession) -> None:
    """``fold`` in SQL text."""
    spark.udf.register("fold", fold_exact)


def is_supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*EXTENSIONS)


def is_hidden_path(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def is_heic(path: Column) -> Column:
    return F.lower(path).rlike(r"\.hei[cf]$")


def _little_endian(number: Column) -> Column:
    """Eight bytes of a long as hexadecimal digits, lowest first."""
    digits = F.lpad(F.hex(number), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])


def version_key(path: Column, mtime: Column, size: Column) -> Column:
    """SHA-256 of path | mtime | size, the numbers as eight little-endian bytes."""
    bar = F.lit("7C")
    return F.sha2(F.unhex(F.concat(F.hex(F.encode(path, "UTF-8")), bar, _little_endian(mtime), bar, _little_endian(size))), 256)


def sort_ts(photo: str = "") -> Column:
    return F.coalesce(F.col(f"{photo}taken_ts"), F.col(f"{photo}mtime"))


def when_of(ts: Column) -> Column:
    return F.timestamp_seconds(ts)


def civil_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Unix seconds; a day beyond its month rolls over."""
    days = F.unix_date(F.make_date(year, month, F.lit(1))) + day - 1
    return days.cast("long") * 86400 + hour * 3600 + minute * 60 + second


def exif_datetime(text: Column) -> Column:
    """Seconds of ``Y:M:D h:m:s`` (or dashes); a missing or broken time counts as 0, a bad date is null."""
    trimmed = F.trim(text)
    date = F.split(F.substring_index(trimmed, " ", 1), "[:-]")
    time = F.split(F.when(F.instr(trimmed, " ") > 0, F.regexp_replace(trimmed, "^[^ ]* ", "")).otherwise(F.lit("00:00:00")), ":")
    part = lambda parts, i: F.get(parts, F.lit(i)).try_cast("int")
    y, m, d = F.trim(F.get(date, F.lit(0))).try_cast("int"), part(date, 1), part(date, 2)
    h, mi, s = (F.coalesce(part(time, i), F.lit(0)) for i in range(3))
    good = (y >= 1900) & (y <= 9999) & m.between(1, 12) & d.between(1, 31)
    return F.when(good, civil_seconds(F.when(good, y), F.when(good, m), d, h, mi, s))


FILE_DATE = (
    r"(?<![0-9])(199[0-9]|20[0-2][0-9]|203[0-5])[-_. T:/]?(0[1-9]|1[0-2])[-_. T:/]?(0[1-9]|[12][0-9]|3[01])"
    r"(?:[-_. T:/]?([0-9]{2})[-_. T:/]?([0-9]{2})(?:[-_. T:/]?([0-9]{2}))?)?"
)


def filename_date(name: Column) -> Column:
    """Seconds of the first plausible date in a file's name, with its time if that is possible."""
    part = lambda i: F.regexp_extract(name, FILE_DATE, i).try_cast("int")
    y, m, d, h, mi = (part(i) for i in range(1, 6))
    s = F.coalesce(part(6), F.lit(0))
    timed = (h <= 23) & (mi <= 59) & (s <= 59)
    zero = F.lit(0)
    use = lambda c: F.when(F.coalesce(timed, F.lit(False)), c).otherwise(zero)
    return F.when(y.isNotNull(), civil_seconds(y, m, d, use(h), use(mi), use(s)))


def dms_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + F.coalesce(minutes, F.lit(0.0)) / 60.0 + F.coalesce(seconds, F.lit(0.0)) / 3600.0
    return F.when(F.upper(F.substring(ref, 1, 1)).isin("S", "W"), -value).otherwise(value)


def valid_point(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def short_number(value: Column) -> Column:
    """A whole number where the value is within 0.05 of one, else one decimal, quarters to the even one."""
    whole = F.round(value)
    return F.when(F.abs(value - whole) < 0.05, whole.cast("long").cast("string")).otherwise(F.format_string("%.1f", F.bround(value, 1)))


def f_number_label(value: Column) -> Column:
    return F.concat(F.lit("ƒ/"), short_number(value))


def exposure_label(seconds: Column) -> Column:
    part = (seconds > 0) & (seconds < 1)
    return F.when(part, F.concat(F.lit("1/"), F.round(1.0 / F.when(part, seconds)).cast("long").cast("string"), F.lit("s"))).otherwise(F.concat(short_number(seconds), F.lit("s")))


def iso_label(value: Column) -> Column:
    return F.concat(F.lit("ISO "), value.cast("string"))


def focal_label(value: Column) -> Column:
    return F.concat(short_number(value), F.lit("mm"))


def camera_label(make: Column, model: Column) -> Column:
    return F.when(make.isNull() | model.isNull(), F.coalesce(model, make)).when(F.contains(F.lower(model), F.lower(make)), model).otherwise(F.concat_ws(" ", make, model))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...], floor: float = 1e-9) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) over their union, which is ``floor`` at least."""
    zero = F.lit(0.0)
    side = lambda lo, hi: F.greatest(hi - lo, zero)
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    area = lambda c: side(c[0], c[2]) * side(c[1], c[3])
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(floor))


def dir_of(path: Column) -> Column:
    return F.when(path.rlike("^.+/"), F.regexp_extract(path, "^(.+/)", 1)).otherwise(path)


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def human_bytes(n: Column) -> Column:
    tenth = lambda unit, label: F.concat(F.format_string("%.1f", n / unit), F.lit(label))
    return (
        F.when(n >= 1e9, tenth(1e9, " GB"))
        .when(n >= 1e6, tenth(1e6, " MB"))
        .when(n >= 1e3, F.concat(F.floor(n / 1e3 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def keeper_penalty(path: Column) -> Column:
    """1 for paths that look like another download or a backup."""
    return path.rlike(r"(?i)download|copia|copy|backup|duplicate|\([0-9]+\)").cast("int")


def greeting(hour: Column) -> Column:
    return F.when(hour < 12, "Good morning").when(hour < 18, "Good afternoon").otherwise("Good evening")


def count_badge(n: Column) -> Column:
    return F.when(n > 999, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def path_bucket(id_: Column) -> Column:
    return F.floor(id_ / 1000)


def is_jpeg(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 2)) == "FFD8"


def month_number(token: str) -> int | None:
    """1 to 12 for an English month or its beginning of three letters or more."""
    return next((i + 1 for i, m in enumerate(MONTHS) if len(token) >= 3 and m.startswith(token)), None)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blob: pd.Series) -> pd.Series:
    import numpy as np

    return blob.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def encode_vector(vector: pd.Series) -> pd.Series:
    import numpy as np

    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def is_settled_row() -> Column:
    return (F.col("thumb_status") == READY) & (F.col("faces_scanned") == 1)

"""Faces from a detector's raw outputs: letterbox geometry and anchor-free decoding.

A photo is scaled into a square and padded evenly; for each stride the network gives a grid of
cells, each with a class and an object score, a box and five landmarks relative to the cell.
Decoding is columns only; overlapping boxes are for ``clusters.suppressed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The square's side, the score that a face needs, the strides.
SIDE, SCORE, STRIDES = 640, 0.6, (8, 16, 32)


def letterbox(width: Column, height: Column, side: int = SIDE) -> tuple[Column, Column, Column]:
    """(scale, left, top): how a photo lies in the square, which is padded on both sides alike."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    pad = lambda v: F.floor((side - F.least(F.greatest(F.floor(v * scale + 0.5), F.lit(1)), F.lit(side))) / 2)
    return scale, pad(width), pad(height)


def candidates(outputs: DataFrame, side: int = SIDE, score: float = SCORE) -> DataFrame:
    """(photo_id, stride, cell, score, x1, y1, x2, y2, landmarks) of every cell that scores enough.

    ``outputs`` has photo_id, width, height and, for each stride, cls, obj, bbox and kps as flat
    arrays of 1, 1, 4 and 10 numbers a cell. Coordinates are shares of the photo, landmarks pixels.
    """
    at = lambda array, place: F.get(F.col(array), place).cast("double")
    cells = F.filter(F.sequence(F.lit(0), F.size("cls") - 1), lambda i: F.get(F.col("cls"), i).cast("double") * F.get(F.col("obj"), i).cast("double") >= score)
    scale, left, top = letterbox(F.col("width"), F.col("height"), side)
    kept = outputs.filter(F.size("cls") > 0).select("*", scale.alias("scale"), left.alias("pad_x"), top.alias("pad_y"), F.explode(cells).alias("cell"))
    wide = F.floor(F.lit(side) / F.col("stride"))
    row, column = F.floor(F.col("cell") / wide), F.col("cell") % wide
    back_x = lambda v: (v * F.col("stride") - F.col("pad_x")) / F.col("scale")
    back_y = lambda v: (v * F.col("stride") - F.col("pad_y")) / F.col("scale")
    box = lambda k: at("bbox", F.col("cell") * 4 + k)
    x, y, half_w, half_h = column + box(0), row + box(1), F.exp(box(2)) / 2, F.exp(box(3)) / 2
    point = lambda k: F.struct(back_x(column + at("kps", F.col("cell") * 10 + 2 * k)).alias("x"), back_y(row + at("kps", F.col("cell") * 10 + 2 * k + 1)).alias("y"))
    return kept.select(
        "photo_id", "stride", "cell", (at("cls", F.col("cell")) * at("obj", F.col("cell"))).alias("score"),
        (back_x(x - half_w) / F.col("width")).alias("x1"), (back_y(y - half_h) / F.col("height")).alias("y1"),
        (back_x(x + half_w) / F.col("width")).alias("x2"), (back_y(y + half_h) / F.col("height")).alias("y2"),
        F.array(*[point(k) for k in range(5)]).alias("landmarks"),
    )

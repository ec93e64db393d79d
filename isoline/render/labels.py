"""Anchors, label candidates and greedy placement.

`first_fit` says what placement means, one label after the other; `place` makes the same choices in parallel (see `placement`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.functions.algorithms import pole_of_inaccessibility
from isoline.functions.geometry import midpoint
from isoline.render.placement import place_in_rounds

#: Horizontal and vertical place of each candidate, in order.
WITH_SYMBOL = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1))
WITHOUT_SYMBOL = ((0, 0), (0, 1), (0, -1), (-1, 0), (1, 0), (-1, 1), (1, 1), (-1, -1), (1, -1))


def anchors(features: DataFrame) -> DataFrame:
    """Adds anchor: the point, the middle of a line, the pole of a polygon, the box's centre for collections."""
    centre = F.struct(((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))
    pole = pole_of_inaccessibility(F.when(F.col("geom_type") == "polygon", F.col("parts")))
    df = features.withColumn("__pole", pole)
    p = F.struct(F.col("__pole.x").alias("x"), F.col("__pole.y").alias("y"))
    at = F.when(F.col("geom_type") == "point", F.col("parts")[0][0]).when(F.col("geom_type") == "line", midpoint(F.col("parts")[0])).when(F.col("__pole").isNotNull(), p).otherwise(centre)
    return df.withColumn("anchor", at).drop("__pole")


def text_size(text: Column, size: Column | float, width_per_character: float = 0.55) -> tuple[Column, Column]:
    """Width and height by a plain model: every character is as wide."""
    size = F.lit(float(size)) if not isinstance(size, Column) else size
    return F.length(text) * size * width_per_character, size


def candidates(x: Column, y: Column, w: Column, h: Column, spacing: Column, symbol: bool) -> Column:
    """Boxes (x0, x1, y0, y1) in order of preference; a box reaches half a height below its place and a whole one above."""
    out = []
    for sx, sy in WITH_SYMBOL if symbol else WITHOUT_SYMBOL:
        cx, cy = x + sx * (w / 2 + spacing), y + sy * (h / 2 + spacing)
        out.append(F.struct((cx - w / 2).alias("x0"), (cx + w / 2).alias("x1"), (cy - h / 2).alias("y0"), (cy + h).alias("y1")))
    return F.array(*out)


class Placed:
    """Boxes in a grid of cells; `free` is strict, so boxes may touch."""

    def __init__(self, cell: float) -> None:
        self.cell, self.grid = cell, {}

    def _cells(self, b):
        for i in range(int(b[0] // self.cell), int(b[1] // self.cell) + 1):
            for j in range(int(b[2] // self.cell), int(b[3] // self.cell) + 1):
                yield i, j

    def free(self, b) -> bool:
        return not any(b[0] < o[1] and b[1] > o[0] and b[2] < o[3] and b[3] > o[2] for c in self._cells(b) for o in self.grid.get(c, ()))

    def add(self, b) -> None:
        for c in self._cells(b):
            self.grid.setdefault(c, []).append(b)


def first_fit(boxes: list[np.ndarray], cell: float) -> list[int]:
    """For each feature the number of its first candidate that overlaps nothing placed before, or -1."""
    placed, out = Placed(cell), []
    for options in boxes:
        k = next((k for k, b in enumerate(options) if placed.free(b)), -1)
        if k >= 0:
            placed.add(options[k])
        out.append(k)
    return out


def place(df: DataFrame, order: str = "seq", boxes: Column | None = None, same: list[str] | None = None) -> DataFrame:
    """df: map_id, a unique order column, boxes (array of candidates). Returns (map_id, order, choice): the candidate's number from 0, -1 for none.

    boxes and same: in place of the column boxes, a function of the columns `same` alone.
    Maps are independent of each other, and a map is not one group: see `placement.place_in_rounds`.
    """
    return place_in_rounds(df, order, boxes=boxes, same=same)

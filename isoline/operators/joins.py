"""Spatial joins as equi joins on grid cells. A pair is kept only in the cell that holds the lower left corner of the common box, so no distinct is needed.

Boxes of any size are allowed: a box lies on the level whose cells (each level's are four times as wide as the last's) are at least half as wide as it, so it
reaches into nine cells of a level at most. Two boxes meet on the coarser of their levels. The side of the finest cells is that of a usual box, found from
the data unless it is given. Cells that hold more than `dense` rows of the left side are dealt over several keys, and what meets them goes to each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.functions.bounds import intersects

STEP, REACH = 4.0, 2.0


def _level(box: tuple, size: float) -> Column:
    side = F.greatest(F.col(box[1]) - F.col(box[0]), F.col(box[3]) - F.col(box[2]))
    return F.greatest(F.lit(0), F.coalesce(F.ceil(F.log(STEP, side / (size * REACH))), F.lit(0))).cast("int")


def _measure(df: DataFrame, box: tuple) -> tuple[float, float]:
    """The usual and the greatest side of boxes, from their four columns only."""
    side = F.greatest(F.col(box[1]) - F.col(box[0]), F.col(box[3]) - F.col(box[2]))
    found = df.agg(F.percentile_approx(F.when(side > 0, side), 0.5, 1000).alias("usual"), F.max(side).alias("most")).first()
    return found["usual"] or 0.0, found["most"] or 0.0


def _grid(sides: list[tuple[DataFrame, tuple]], size: float | None, top: int | None = None) -> tuple[float, int]:
    """(side of the finest cells, coarsest level that the boxes need)."""
    if size is not None and top is not None:
        return size, top
    found = [_measure(df, box) for df, box in sides]
    if size is None:
        size = max((usual for usual, _ in found), default=0.0) or 1.0
    most = max(m for _, m in found)
    return size, top if top is not None else max(0, math.ceil(math.log(most / (size * REACH), STEP))) if most > 0 else 0


#: Dense cells that are told to all tasks at most.
SMALL = 100_000


def _dealt(a: DataFrame, b: DataFrame, dense: int) -> tuple[DataFrame, DataFrame]:
    """Adds __lpart and __rpart: a row of a in one part of its cell, a row of b in all; a part has about `dense` rows of a."""
    cell = ["__cx", "__cy", "__level"]
    hot = a.groupBy(*(F.col(f"__l{c[2:]}").alias(c) for c in cell)).agg(F.count("*").alias("__n")).where(F.col("__n") > dense).withColumn("__parts", F.ceil(F.col("__n") / dense).cast("int")).drop("__n")
    hot = hot.persist()
    hot = F.broadcast(hot) if hot.count() <= SMALL else hot
    at = lambda side: F.expr(" and ".join(f"__{side}{c[2:]} = {c}" for c in cell))
    parts = F.coalesce("__parts", F.lit(1))
    left = a.join(hot, at("l"), "left").withColumn("__lpart", F.pmod(F.xxhash64(*a.columns), parts).cast("int")).drop(*cell, "__parts")
    right = b.join(hot, at("r"), "left").withColumn("__rpart", F.explode(F.sequence(F.lit(0), parts - 1))).drop(*cell, "__parts")
    return left, right


def _cells(df: DataFrame, box: tuple, size: float, prefix: str, top: int, own_only: bool = False) -> DataFrame:
    """The cells of each box on its own level and, unless own_only, on the coarser ones."""
    level = F.least(_level(box, size), F.lit(top)) if top else F.lit(0)
    df = df.withColumn(f"{prefix}own", level)
    df = df.withColumn(f"{prefix}level", F.explode(F.sequence(f"{prefix}own", F.lit(top))) if top and not own_only else F.col(f"{prefix}own"))
    side = F.lit(size) * F.pow(F.lit(STEP), F.col(f"{prefix}level")) if top else F.lit(size)

    def cover(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side))

    return df.withColumn(f"{prefix}cx", F.explode(cover(box[0], box[1]))).withColumn(f"{prefix}cy", F.explode(cover(box[2], box[3])))


_SAME = "__lcx = __rcx and __lcy = __rcy and __llevel = __rlevel"
_OWN = ("__lcx", "__lcy", "__llevel", "__lown", "__rcx", "__rcy", "__rlevel", "__rown", "__lpart", "__rpart")


def bbox_join(left: DataFrame, right: DataFrame, left_box: tuple, right_box: tuple, size: float | None = None, dense: int | None = None, same: tuple[str, str] | None = None) -> DataFrame:
    """Pairs whose boxes strictly overlap. Column names of the two sides must differ. size: the side of a grid cell; dense: rows of left that a key holds at most (one more scan of left); same: a column of each side, equal in a pair and part of the key."""
    size, top = _grid([(left, left_box), (right, right_box)], size)
    a, b = _cells(left, left_box, size, "__l", top), _cells(right, right_box, size, "__r", top)
    side = F.lit(size) * F.pow(F.lit(STEP), F.col("__llevel")) if top else F.lit(size)
    corner = lambda k: F.floor(F.greatest(F.col(left_box[k]), F.col(right_box[k])) / side)
    on = F.expr(f"{_SAME} and __llevel = greatest(__lown, __rown)") & intersects(left_box, right_box) & (F.col("__lcx") == corner(0)) & (F.col("__lcy") == corner(2))
    if dense is not None:
        a, b = _dealt(a, b, dense)
        on = on & F.expr("__lpart = __rpart")
    if same is not None:
        on = on & (F.col(same[0]) == F.col(same[1]))
    return a.join(b, on).drop(*_OWN)


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, box: tuple, size: float | None = None, how: str = "inner", top: int | None = None, dense: int | None = None) -> DataFrame:
    """Pairs of a point and a box that holds it (inclusive); how: also left, left_semi or left_anti. A point has one cell on each level that boxes need.

    With more than one level, left and left_anti go through the pairs' points, so points must then have distinct rows to be told apart. top: the coarsest level, where it is known (and size is given); dense: as for bbox_join.
    """
    size, top = _grid([(boxes, box)], size, top)
    b = _cells(boxes, box, size, "__r", top, own_only=True)
    a = points.withColumn("__llevel", F.explode(F.sequence(F.lit(0), F.lit(top))) if top else F.lit(0))
    side = F.lit(size) * F.pow(F.lit(STEP), F.col("__llevel")) if top else F.lit(size)
    a = a.withColumn("__lcx", F.floor(F.col(x) / side)).withColumn("__lcy", F.floor(F.col(y) / side))
    on = F.expr(_SAME) & F.col(x).between(F.col(box[0]), F.col(box[1])) & F.col(y).between(F.col(box[2]), F.col(box[3]))
    if dense is not None:
        a, b = _dealt(a, b, dense)
        on = on & F.expr("__lpart = __rpart")
    if not top or how == "inner":
        return a.join(b, on, how).drop(*_OWN)
    found = a.join(b, on, "left_semi").select(points.columns).distinct()
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in points.columns]
    match = same[0]
    for s in same[1:]:
        match = match & s
    if how in ("left_semi", "left_anti"):
        return points.alias("p").join(found.alias("f"), match, how)
    none = points.alias("p").join(found.alias("f"), match, "left_anti")
    return a.join(b, on).drop(*_OWN).unionByName(none, allowMissingColumns=True)

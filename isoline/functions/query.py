"""Predicates on features that compile to a Spark column and to the text of an OSM web query.

A predicate is a disjunction of conjunctions of tag conditions, and one box for all of them: what the query language can say. Anything else raises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from isoline.functions import tags as T
from isoline.functions.bounds import contains_point, within
from isoline.functions.tags import overpass_ql

#: The query language's names of kinds.
KIND_NAMES = {"point": "node", "line": "way", "polygon": "way", "shape": "nwr"}
_ALL = (float("-inf"), float("inf"), float("-inf"), float("inf"))


@dataclass(frozen=True)
class Predicate:
    """any_of: alternatives, each a tuple of (key,), (key, value) or (key, value, '!='); box: xmin, xmax, ymin, ymax."""

    any_of: tuple = ((),)
    box: tuple = _ALL

    def __and__(self, other: Predicate) -> Predicate:
        alternatives = tuple(dict.fromkeys(a + tuple(c for c in b if c not in a) for a in self.any_of for b in other.any_of))
        a, b = self.box, other.box
        return Predicate(alternatives, (max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3])))

    def __or__(self, other: Predicate) -> Predicate:
        if self.box != other.box:
            raise ValueError("alternatives must share their box")
        return Predicate(tuple(dict.fromkeys(self.any_of + other.any_of)), self.box)

    def column(self, tags: str = "tags", x: Column | None = None, y: Column | None = None, box: tuple | None = None) -> Column:
        """As a filter; of a point's x and y, or of a feature's box, which must lie within."""
        def one(c: tuple) -> Column:
            return T.has_tag(tags, c[0]) if len(c) == 1 else T.tag_eq(tags, *c) if len(c) == 2 else T.tag_ne(tags, c[0], c[1])

        out = F.lit(False)
        for a in self.any_of:
            each = F.lit(True)
            for c in a:
                each = each & one(c)
            out = out | each
        if self.box != _ALL:
            out = out & (within(box, self.box) if box is not None else contains_point(self.box, x, y))
        return out

    def text(self, kind: str = "shape", take: int | None = None, timeout: int | None = None) -> str:
        if kind not in KIND_NAMES:
            raise ValueError(f"no kind {kind}")
        if self.box != _ALL and float("inf") in map(abs, self.box):
            raise ValueError("a box needs four sides")
        return overpass_ql(KIND_NAMES[kind], [list(a) for a in self.any_of], None if self.box == _ALL else self.box, take, timeout)


def tag_is(key: str, value: str) -> Predicate:
    return Predicate((((key, value),),))


def tag_is_not(key: str, value: str) -> Predicate:
    return Predicate((((key, value, "!="),),))


def tag_exists(key: str) -> Predicate:
    return Predicate((((key,),),))


def tag_among(key: str, values) -> Predicate:
    return Predicate(tuple(((key, v),) for v in values))


def inside(box: tuple) -> Predicate:
    return Predicate(box=tuple(map(float, box)))


def coordinate(axis: str, sign: str, value: float) -> Predicate:
    """A bound of x or y: sign is >= or <=."""
    place = {("x", ">="): 0, ("x", "<="): 1, ("y", ">="): 2, ("y", "<="): 3}.get((axis, sign))
    if place is None:
        raise ValueError(f"cannot say {axis} {sign}")
    box = list(_ALL)
    box[place] = float(value)
    return Predicate(box=tuple(box))

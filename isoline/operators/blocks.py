"""Grid joins of many boxes by blocks: a cell's rows lie in lists of about `BLOCK` (pairs of one table: `TIMES` as many), each two lists of a cell meet as arrays in one row of a mapInArrow.

For joins whose pairs are far more than their rows. Boxes and places that are alike are met once; a cell of any number of rows is many blocks,
which tasks share, so no task holds more than two lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.operators.joins import SMALL, _cells, _grid

BLOCK = 2048
#: Copies of one box that a row holds, and keys that a batch of pairs holds, at most (about).
COPIES, KEYS = 4096, 1 << 20
#: Boxes of a list that are met at a time when products are sought, boxes that make it one at least, and keys that a cycle has at most.
COLUMNS, ALIKE, RUN = 32, 4, 256
#: BLOCKs in a list of boxes that are met with one another: the longer the lists, the larger the products.
TIMES = 4
_CELL = ["__cx", "__cy", "__level"]


def _wide(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _lists(df: DataFrame, columns: list[str], name: str, times: int = 1, keys: str | None = None) -> DataFrame:
    """(cell, __part, name): lists of a cell's rows, about `times` BLOCK each, and fewer where their arrays `keys` hold more than KEYS."""
    parts = F.ceil(F.greatest(F.count("*") / (times * BLOCK), F.sum(F.size(keys)) / KEYS if keys else F.lit(0.0)))
    parts = df.groupBy(*_CELL).agg(parts.cast("int").alias("__parts"))
    dealt = df.join(parts, _CELL).withColumn("__part", F.pmod(F.xxhash64(*columns), F.col("__parts")).cast("int"))
    return dealt.groupBy(*_CELL, "__part").agg(F.collect_list(F.struct(*columns)).alias(name))


def _met(a: DataFrame, b: DataFrame, size: float, own: bool, f, schema: str) -> DataFrame:
    """f(level, cx, cy, side, lists of a, lists of b, whether both are one list) yields record batches. own: a and b are the same lists, each two of which meet once."""
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in _CELL]
    pairs = a.alias("a").join(b.alias("b"), on + [F.col("a.__part") <= F.col("b.__part")] if own else on)
    pairs = pairs.select(*(F.col(f"a.{c}").alias(c) for c in _CELL), F.col("a.__part").alias("__p"), F.col("b.__part").alias("__q"), "left", "right").repartition(_wide(a), *_CELL, "__p", "__q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            for k, (cx, cy, level, p, q) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*_CELL, "__p", "__q")))):
                yield from f(level, cx, cy, size * 4.0**level, left[k].values, right[k].values, own and p == q)

    return pairs.mapInArrow(run, schema)


def _columns(s: pa.StructArray, names: tuple[str, ...]) -> list[np.ndarray]:
    return [s.field(n).to_numpy(zero_copy_only=False) for n in names]


def _gathered(lists: pa.ListArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of the lists at `at`, one after the other."""
    start, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    n = (start[1:] - start[:-1])[at].astype(np.int64)
    ends = np.cumsum(n)
    return n, values[np.repeat(start[:-1][at] - (ends - n), n) + np.arange(n.sum())]


def _ordered(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lower, higher): parts of two sorted lists, each key of the first below each of the second; all pairs of unequal keys, once. As large as they can be: the lists are halved where they mix."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if a[-1] < b[0]:
            yield a, b
        elif b[-1] < a[0]:
            yield b, a
        elif a[0] == a[-1] or b[0] == b[-1]:
            one, many = (a, b) if a[0] == a[-1] else (b, a)
            yield many[: many.searchsorted(one[0])], one
            yield one, many[many.searchsorted(one[0], "right") :]
        else:
            longer = a if len(a) >= len(b) else b
            at = longer[max(len(longer) // 2, longer.searchsorted(longer[0], "right"))]
            i, j = a.searchsorted(at), b.searchsorted(at)
            yield a[:i], b[j:]
            yield b[:j], a[i:]
            todo += [(a[:i], b[:j]), (a[i:], b[j:])]


def _ordered_within(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of one sorted list with itself."""
    todo = [keys]
    while todo:
        keys = todo.pop()
        if len(keys) and keys[0] < keys[-1]:
            at = max(len(keys) // 2, keys.searchsorted(keys[0], "right"))
            at = keys.searchsorted(keys[at])
            yield keys[:at], keys[at:]
            todo += [keys[:at], keys[at:]]


def _runs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(outer, inner, whether outer has the lower keys): each key of outer stands before all of inner. Runs of one key and cycles of as many keys as bytes have bits are what files shorten best."""
    outer, inner, first = (low, high, True) if len(low) <= len(high) else (high, low, False)
    even = len(inner) // 8 * 8
    for m in range(0, len(outer), KEYS // 16):
        some = outer[m : m + KEYS // 16]
        for k in range(0, even, RUN):
            yield some, inner[k : min(k + RUN, even)], first
        if even < len(inner) and len(some):
            yield (inner[even:], some, not first) if len(some) > len(inner) - even else (some, inner[even:], first)


def _batches(rows: Iterator[tuple[np.ndarray, np.ndarray, bool]]) -> Iterator[pa.RecordBatch]:
    def lists(held):
        for column in held:
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, column)]), pa.int32()), pa.array(np.concatenate(column)))

    held, n = ([], [], []), 0
    for row in rows:
        for column, value in zip(held, row):
            column.append(value)
        n += len(row[0]) + len(row[1])
        if n > KEYS // 8:
            yield pa.RecordBatch.from_arrays([*lists(held[:2]), pa.array(held[2])], names=["outer", "inner", "first"])
            held, n = ([], [], []), 0
    if n:
        yield pa.RecordBatch.from_arrays([*lists(held[:2]), pa.array(held[2])], names=["outer", "inner", "first"])


def _products(meets, akeys: pa.ListArray, bkeys: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (of a, of b), sorted, of products that cover the pairs. meets(columns): whether each a meets these b. In some columns at a time, rows that are alike are one product; then each row for itself with what is left, which is kept as bits."""
    keys = lambda lists, at: np.sort(_gathered(lists, at)[1])
    rest = np.zeros((len(akeys), -(-len(bkeys) // COLUMNS), COLUMNS // 8), np.uint8)
    for c in range(rest.shape[1]):
        on = meets(slice(c * COLUMNS, (c + 1) * COLUMNS))
        bits = np.zeros((len(akeys), COLUMNS // 8), np.uint8)
        bits[:, : -(-on.shape[1] // 8)] = np.packbits(on, axis=1)
        known, kind, count = np.unique(bits.view(f"u{COLUMNS // 8}")[:, 0], return_inverse=True, return_counts=True)
        many = (count >= ALIKE) & (known != 0)
        order, ends = np.argsort(kind, kind="stable"), np.cumsum(count)
        for g in np.flatnonzero(many):
            rows = order[ends[g] - count[g] : ends[g]]
            yield keys(akeys, rows), keys(bkeys, np.flatnonzero(on[rows[0]]) + c * COLUMNS)
        rest[:, c] = np.where(many[kind][:, None], 0, bits)
    rest = rest.reshape(len(akeys), -1)
    for k in np.flatnonzero(rest.any(axis=1)):
        yield keys(akeys, np.array([k])), keys(bkeys, np.flatnonzero(np.unpackbits(rest[k])))


def _sorted(s: pa.StructArray) -> tuple[list[np.ndarray], pa.ListArray]:
    """The columns and keys of boxes, neighbours side by side."""
    x0, x1, y0, y1, own = _columns(s, ("x0", "x1", "y0", "y1", "own"))
    order = np.lexsort((y1, x1, y0, x0))
    return [c[order] for c in (x0, x1, y0, y1, own)], s.field("keys").take(pa.array(order))


def _met_pairs(level: int, cx: int, cy: int, side: float, a: pa.StructArray, b: pa.StructArray, same: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _runs for the pairs of a cell's two lists."""
    (ax0, ax1, ay0, ay1, aown), akeys = left = _sorted(a)
    (bx0, bx1, by0, by1, bown), bkeys = left if same else _sorted(b)
    inside = [(np.floor(a0 / side) == at, np.floor(b0 / side) == at) for a0, b0, at in ((ax0, bx0, cx), (ay0, by0, cy))] + [(aown == level, bown == level)]
    number = np.arange(len(ax0))

    def meets(k):
        on = (ax1[:, None] > bx0[k]) & (ax0[:, None] < bx1[k]) & (ay1[:, None] > by0[k]) & (ay0[:, None] < by1[k])
        for u, v in inside:
            on &= u[:, None] | v[k]
        return on & (number[:, None] < number[k]) if same else on

    def rows():
        for u, v in _products(meets, akeys, bkeys):
            for low, high in _ordered(u, v):
                yield from _runs(low, high)
        for k in np.flatnonzero(inside[0][0] & inside[1][0] & inside[2][0]) if same else ():
            for low, high in _ordered_within(np.sort(akeys[k].values.to_numpy())):
                yield from _runs(low, high)

    yield from _batches(rows())


def self_pairs(boxes: DataFrame, key: str, box: tuple, size: float | None = None) -> DataFrame:
    """(a, b): keys, a < b, of rows whose boxes strictly overlap. Boxes that are alike are met once and their keys expanded in the last step, in products of two lists of keys where many boxes overlap the same others: such rows take little place in files."""
    size, top = _grid([(boxes, box)], size)
    given = boxes.select(F.col(key).cast("long").alias("__key"), *(F.col(c).cast("double").alias(n) for c, n in zip(box, ("x0", "x1", "y0", "y1"), strict=True)))
    given = given.where("__key is not null and x0 < x1 and y0 < y1")
    one = ["x0", "x1", "y0", "y1"]
    hot = given.groupBy(*one).agg(F.count("*").alias("__n")).where(F.col("__n") > COPIES).withColumn("__copies", F.ceil(F.col("__n") / COPIES)).drop("__n").persist()
    hot = F.broadcast(hot) if hot.count() <= SMALL else hot
    alike = given.join(hot, one, "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("__key"), F.col("__copies")), F.lit(0)).cast("int")).groupBy(*one, "copy").agg(F.collect_list("__key").alias("keys"))
    cells = _cells(alike, tuple(one), size, "__", top)
    lists = _lists(cells.withColumnRenamed("__own", "own"), [*one, "copy", "own", "keys"], "left", TIMES, "keys")
    met = _met(lists, lists.withColumnRenamed("left", "right"), size, True, _met_pairs, "outer array<long>, inner array<long>, first boolean")
    every = met.withColumn("o", F.explode("outer")).withColumn("i", F.explode("inner"))
    return every.select(F.when(F.col("first"), F.col("o")).otherwise(F.col("i")).alias("a"), F.when(F.col("first"), F.col("i")).otherwise(F.col("o")).alias("b"))


def totals_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, box: tuple, n: str | None = None, value: str | None = None, by: str | None = None, size: float | None = None) -> DataFrame:
    """The rows of boxes (box columns as they are), once for each value of `by` (a long column of points, optional) that their points (inclusive) have, with n (the points, or the sum of column n) and, where value is given, vmin and vmax. Boxes without points are left out."""
    size, top = _grid([(boxes, box)], size)
    one = ["x0", "x1", "y0", "y1"]
    alike = boxes.select(*(F.col(c).cast("double").alias(k) for c, k in zip(box, one, strict=True))).where("x0 <= x1 and y0 <= y1").distinct()
    places = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(by) if by else F.lit(0)).cast("long").alias("by"), (F.col(n) if n else F.lit(1)).cast("long").alias("n"), (F.col(value) if value else F.lit(None)).cast("double").alias("v"))
    places = places.where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("x", "y", "by").agg(F.sum("n").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    side = F.lit(size) * F.pow(F.lit(4.0), F.col("__level")) if top else F.lit(size)
    at = places.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(top))) if top else F.lit(0)).withColumn("__cx", F.floor(F.col("x") / side)).withColumn("__cy", F.floor(F.col("y") / side))
    a = _lists(_cells(alike, tuple(one), size, "__", top, own_only=True), one, "left")
    b = _lists(at, ["x", "y", "by", "n", "vmin", "vmax"], "right")

    def totals(level, cx, cy, side, a, b, same):
        x0, x1, y0, y1 = _columns(a, ("x0", "x1", "y0", "y1"))
        px, py, group, count = _columns(b, ("x", "y", "by", "n"))
        order = np.argsort(group, kind="stable")
        px, py, group, count = px[order], py[order], group[order], count[order]
        least, most = (c.astype(float)[order] for c in _columns(b, ("vmin", "vmax")))
        known = b.field("vmin").is_valid().to_numpy(zero_copy_only=False)[order]
        odd = known & np.isnan(most)  # NaN is the greatest value
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for k in range(0, len(x0), 256):
            r = slice(k, k + 256)
            on = (px >= x0[r, None]) & (px <= x1[r, None]) & (py >= y0[r, None]) & (py <= y1[r, None])
            hits = np.add.reduceat(np.where(on, count, 0), starts, axis=1)
            some = np.logical_or.reduceat(on, starts, axis=1)
            i, j = np.nonzero(some)
            if not len(i):
                continue
            if value:
                low = np.fmin.reduceat(np.where(on, least, np.nan), starts, axis=1)[i, j]
                high = np.fmax.reduceat(np.where(on, most, np.nan), starts, axis=1)[i, j]
                none = ~np.logical_or.reduceat(on & known, starts, axis=1)[i, j]
                if odd.any():
                    high[np.logical_or.reduceat(on & odd, starts, axis=1)[i, j]] = np.nan
            else:
                low = high = np.full(len(i), np.nan)
                none = np.ones(len(i), bool)
            out = [*(pa.array(c[r][i]) for c in (x0, x1, y0, y1)), pa.array(group[starts][j]), pa.array(hits[i, j]), pa.array(low, mask=none), pa.array(high, mask=none)]
            yield pa.RecordBatch.from_arrays(out, names=[*one, "by", "n", "vmin", "vmax"])

    met = _met(a, b, size, False, totals, "x0 double, x1 double, y0 double, y1 double, by long, n long, vmin double, vmax double")
    found = met.groupBy(*(F.col(c).alias(f"__{c}") for c in one), "by").agg(F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))
    out = boxes.join(found, [F.col(c).cast("double") == F.col(f"__{k}") for c, k in zip(box, one, strict=True)]).drop(*(f"__{c}" for c in one))
    return out.withColumnRenamed("by", by) if by else out.drop("by")

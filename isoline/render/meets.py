"""Rows of boxes meet placed boxes of their map by tiles, as arrays: each row lies in one tile, a placed box in all whose rows may reach it.

Tiles are as wide as the widest row of the map reaches. A tile's placed boxes come first and are held, its rows stream past them in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = ("x0", "x1", "y0", "y1")
#: Boxes that meet placed ones at once: those next to each other, so that few placed ones are near.
CHUNK, NEAR = 512, 512
#: A little more than the reach, as sides are rounded.
SLACK = 1.000001


def nearby(boxes: list[np.ndarray], placed: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions of boxes, positions of placed boxes, matrix of those that strictly overlap): every pair that does is in one of them."""
    order = np.argsort(boxes[2], kind="stable")
    for a in range(0, len(order), CHUNK):
        at = order[a : a + CHUNK]
        x0, x1, y0, y1 = (b[at] for b in boxes)
        near = np.flatnonzero((placed[0] < np.fmax.reduce(x1)) & (placed[1] > np.fmin.reduce(x0)) & (placed[2] < np.fmax.reduce(y1)) & (placed[3] > np.fmin.reduce(y0)))
        for b in range(0, len(near), NEAR):
            to = near[b : b + NEAR]
            p0, p1, q0, q1 = (p[to] for p in placed)
            yield at, to, (x0[:, None] < p1) & (x1[:, None] > p0) & (y0[:, None] < q1) & (y1[:, None] > q0)


def overlapped(boxes: list[np.ndarray], placed: list[np.ndarray]) -> np.ndarray:
    """Whether each box overlaps a placed one."""
    out = np.zeros(len(boxes[0]), bool)
    for at, _, on in nearby(boxes, placed):
        out[at] |= on.any(axis=1)
    return out


def _starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where a batch's rows begin a key other than the row before."""
    new = np.zeros(batch.num_rows, bool)
    for c in keys:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = True
    return np.flatnonzero(new).tolist()


def by_tiles(rows: DataFrame, sides: list[Column], placed: DataFrame, reaches: DataFrame, f: Callable, schema, low: tuple[Column, Column] | None = None) -> DataFrame:
    """rows: map_id and columns of which the four arrays `sides` are functions; placed: map_id, seq, x0, x1, y0, y1; reaches: m, reach, one row a map, which no row and no placed box exceeds;
    low: the least x0 and y0 of a row, where they are known.

    f(batch of rows, where each row's boxes begin, the boxes, the placed boxes of the tile, their seq) gives a record batch of the schema. Only the rows' own
    columns are shuffled. Rows need a box at least.
    """
    keys, tasks = ["map_id", "__tx", "__ty"], 4 * rows.sparkSession.sparkContext.defaultParallelism
    reach = reaches.select("m", F.col("reach").alias("__reach"))
    of_map = lambda df: df.join(reach, F.col("map_id").eqNullSafe(F.col("m"))).drop("m")
    own = {t: F.floor(s / F.col("__reach")) for t, s in zip(keys[1:], low or (F.array_min(sides[0]), F.array_min(sides[2])), strict=True)}
    labels = of_map(rows).withColumns({**own, "__role": F.lit(1)}).drop("__reach")
    cover = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - F.col("__reach") * SLACK) / F.col("__reach")), F.floor(F.col(hi) / F.col("__reach"))))
    box = [f"__p{s}" for s in SIDES]
    fixed = placed.select("map_id", F.col("seq").alias("__pseq"), *(F.col(s).alias(b) for s, b in zip(SIDES, box, strict=True)))
    fixed = of_map(fixed).withColumn("__tx", cover(box[0], box[1])).withColumn("__ty", cover(box[2], box[3])).withColumn("__role", F.lit(0)).drop("__reach")
    both = labels.unionByName(fixed, allowMissingColumns=True).repartition(tasks, *keys).sortWithinPartitions(*keys, "__role")
    both = both.withColumns({f"__{s}": F.coalesce(c, F.array().cast("array<double>")) for s, c in zip(SIDES, sides, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, keys)
            role = batch.column("__role").to_numpy()
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                here = tuple(batch.column(c)[a].as_py() for c in keys)
                if here != key:
                    key, held, seqs, known = here, [], [], None
                first = a + int(np.count_nonzero(role[a:b] == 0))
                if first > a:
                    part = batch.slice(a, first - a)
                    held.append([part.column(c).to_numpy(zero_copy_only=False) for c in box])
                    seqs.append(part.column("__pseq").to_numpy(zero_copy_only=False))
                if first == b:
                    continue
                if known is None:
                    known = ([np.concatenate(c) for c in zip(*held)], np.concatenate(seqs)) if held else ([np.empty(0)] * 4, np.empty(0))
                part = batch.slice(first, b - first)
                lists = [part.column(f"__{s}") for s in SIDES]
                at = lists[0].offsets.to_numpy().astype(np.int64)
                flat = [c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in lists]
                yield f(part, at - at[0], flat, *known)

    return both.mapInArrow(run, schema)


def passed_over(rows: DataFrame, boxes: Column, placed: DataFrame) -> DataFrame:
    """The boxes of rows (map_id, first) that no placed one (map_id, seq, x0, x1, y0, y1) before `first` overlaps: (map_id, x0, x1, y0, y1, rival: the first that does)."""
    sides = [F.coalesce(boxes.getField(s), F.array().cast("array<double>")) for s in SIDES]
    wide = rows.select("map_id", F.greatest(F.array_max(sides[1]) - F.array_min(sides[0]), F.array_max(sides[3]) - F.array_min(sides[2])).alias("wide"))
    wide = wide.unionByName(placed.select("map_id", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("wide")))
    reaches = wide.groupBy(F.col("map_id").alias("m")).agg(F.greatest(F.max("wide"), F.lit(1e-9)).alias("reach"))
    schema = T.StructType([rows.schema["map_id"], *(T.StructField(s, T.DoubleType()) for s in SIDES), T.StructField("rival", T.LongType())])

    def run(batch: pa.RecordBatch, at: np.ndarray, flat: list[np.ndarray], others: list[np.ndarray], seq: np.ndarray) -> pa.RecordBatch:
        row = np.repeat(np.arange(batch.num_rows), at[1:] - at[:-1])
        first, seq, none = batch.column("first").to_numpy()[row], seq.astype(np.int64), np.iinfo(np.int64).max
        just = np.zeros(len(row), bool)
        for i, j, on in nearby(flat, others):
            just[i] |= (on & (seq[j] < first[i][:, None])).any(axis=1)
        bad = np.flatnonzero(~just)
        rival = np.full(len(bad), none)
        for i, j, on in nearby([c[bad] for c in flat], others):
            rival[i] = np.minimum(rival[i], np.where(on, seq[j], none).min(axis=1))
        out = [batch.column("map_id").take(pa.array(row[bad])), *(pa.array(c[bad]) for c in flat), pa.array(rival, mask=rival == none)]
        return pa.RecordBatch.from_arrays(out, names=["map_id", *SIDES, "rival"])

    return by_tiles(rows, sides, placed, reaches, run, schema)

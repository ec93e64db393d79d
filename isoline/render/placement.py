"""First-fit placement of labels in parallel: the same choices as one label after the other, without one task for a map.

A label takes its first place that overlaps nothing placed before it, so it depends on earlier labels within reach only. A map is cut into tiles at least
twice as wide as its widest label reaches, wider where labels are few. In each round a tile goes through its labels in order, seeing every label that
reaches into it: a place that overlaps a decided label is refused; one that overlaps a place which an earlier, undecided label of another tile may still
take makes the label wait; any other is taken. Each round moves the tiles by half their width, so what waited at a border is inside of one. The first
undecided label of all can always decide, so the rounds end; in practice all labels are decided in a few.

Labels with the same boxes are told apart by their order only: of those, no more can be placed than they have places, and they are the first ones. The others
are settled before the rounds, so what these hold grows with different labels, not with copies.

Where labels crowd, most are refused by the first ones. So a map's labels enter the rounds in parts of its order, each `STEP` times as large as the ones before,
and those of a part to which placed labels of earlier parts leave no place do not enter. What the rounds hold then grows with what there is room for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoline.render.meets import SIDES, by_tiles, overlapped
from isoline.sources.steps import Steps

#: Labels that a tile should not exceed (tiles do not get smaller than labels allow), and levels of tile sizes, each twice as wide.
TILE_LABELS, LEVELS = 10_000, 16
SHIFTS = ((0.0, 0.0), (0.5, 0.5), (0.5, 0.0), (0.0, 0.5))
#: Rows of a table that is sent to all tasks at most.
SMALL = 100_000
#: Labels of the first part of a map's order in its fullest tile (about), how much longer the order gets with each further part, and parts after the first at most.
FIRST, STEP, PARTS = 250, 4, 8


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _hits(grid: dict, b: tuple, cell: float) -> bool:
    x0, x1, y0, y1 = b
    for i in range(int(x0 // cell), int(x1 // cell) + 1):
        for j in range(int(y0 // cell), int(y1 // cell) + 1):
            for o in grid.get((i, j), ()):
                if x0 < o[1] and x1 > o[0] and y0 < o[3] and y1 > o[2]:
                    return True
    return False


def _add(grid: dict, b: tuple, cell: float) -> None:
    for i in range(int(b[0] // cell), int(b[1] // cell) + 1):
        for j in range(int(b[2] // cell), int(b[3] // cell) + 1):
            grid.setdefault((i, j), []).append(b)


def decide(labels: list[tuple], decided: list[list], cell: float, region: tuple) -> list[tuple[int, int, int | None]]:
    """labels: (order, own, first possible place, boxes), decided: boxes. Returns (position, next place, choice or None while it waits) of the own labels.

    region: all boxes of own labels lie in it, so others need not be kept.
    """
    taken, maybe, out = {}, {}, []
    left, right, bottom, top = region
    for b in decided:
        _add(taken, b, cell)
    for at in sorted(range(len(labels)), key=lambda i: labels[i][0]):
        _, own, k, boxes = labels[at]
        if own:
            while k < len(boxes) and _hits(taken, boxes[k], cell):
                k += 1
            if k == len(boxes):
                out.append((at, k, -1))
                continue
            if not _hits(maybe, boxes[k], cell):
                _add(taken, boxes[k], cell)
                out.append((at, k, k))
                continue
            out.append((at, k, None))
        for b in boxes[k:]:
            if (own or (b[0] < right and b[1] > left and b[2] < top and b[3] > bottom)) and not _hits(taken, b, cell):
                _add(maybe, b, cell)
    return out


def _tiles(df: DataFrame, shift: tuple[float, float]) -> DataFrame:
    """Adds tx, ty: every tile that a row's boxes reach into or whose labels may reach them, and ox, oy: its own."""
    low = lambda side, k: F.floor(F.array_min(side) / F.col("tile") + k)
    cover = lambda lo, hi, k: F.sequence(F.floor((F.array_min(lo) - F.col("reach")) / F.col("tile") + k), F.floor(F.array_max(hi) / F.col("tile") + k))
    df = df.withColumns({"ox": low("x0", shift[0]), "oy": low("y0", shift[1])})
    return df.withColumn("tx", F.explode(cover("x0", "x1", shift[0]))).withColumn("ty", F.explode(cover("y0", "y1", shift[1])))


def _boxes(table: pa.Table) -> list[list[list[float]]]:
    """The boxes of each row."""
    sides = [table.column(s).combine_chunks() for s in SIDES]
    flat = np.column_stack([s.values.to_numpy(zero_copy_only=False)[s.offsets[0].as_py() : s.offsets[-1].as_py()] for s in sides]).tolist()
    at = (sides[0].offsets.to_numpy() - sides[0].offsets[0].as_py()).tolist()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _round(kind: str, order_kind: str, seq_type: pa.DataType, map_type: pa.DataType, shift: tuple[float, float]):
    boxes = [pa.field(s, pa.list_(pa.float64())) for s in SIDES]
    schema = pa.schema([("map_id", map_type), ("seq", seq_type), ("k", pa.int32()), ("choice", pa.int32()), *boxes, ("reach", pa.float64()), ("tile", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        if not (role == 0).any():
            return schema.empty_table()
        corners, seq, first = _boxes(table), table.column("seq").to_pylist(), table.column("k").to_pylist()
        tile, reach = table.column("tile")[0].as_py(), table.column("reach")[0].as_py()
        x, y = ((table.column(t)[0].as_py() - s) * tile for t, s in zip(("tx", "ty"), shift, strict=True))
        open_ = np.flatnonzero(role < 2).tolist()
        sides = np.array([corners[i][0] for i in open_])
        cell = max(float(np.maximum(sides[:, 1] - sides[:, 0], sides[:, 3] - sides[:, 2]).mean()), 1e-9)
        labels = [(seq[i], role[i] == 0, first[i], corners[i]) for i in open_]
        found = decide(labels, [corners[i][0] for i in np.flatnonzero(role == 2).tolist()], cell, (x, x + tile + reach, y, y + tile + reach))
        same = table.take(pa.array([open_[f[0]] for f in found]))
        values = {"k": pa.array([f[1] for f in found], pa.int32()), "choice": pa.array([f[2] for f in found], pa.int32())}
        return pa.Table.from_arrays([values[f.name] if f.name in values else same.column(f.name).cast(f.type) for f in schema], schema=schema)

    arrays = ", ".join(f"{s} array<double>" for s in SIDES)
    return run, f"map_id {kind}, seq {order_kind}, k int, choice int, {arrays}, reach double, tile double"


def _sides(boxes: Column | None) -> list[Column]:
    """The four arrays of sides: of the boxes, or the columns of those names."""
    if boxes is None:
        return [F.col(s) for s in SIDES]
    return [F.coalesce(boxes.getField(s).cast("array<double>"), F.array().cast("array<double>")) for s in SIDES]


def _ranked(df: DataFrame, order: str, same: list[str] | None) -> DataFrame:
    """(map_id, seq, the columns `same` or four arrays of sides, __rank among the labels of a map that are alike)."""
    seq = F.col(order).alias("seq")
    if same is None:
        flat = df.select("map_id", seq, *(c.alias(s) for s, c in zip(SIDES, _sides(F.col("boxes")), strict=True)))
        keys = [F.xxhash64("map_id", *SIDES), *map(F.col, SIDES)]  # the digest sorts quickly, the sides tell
    else:
        flat, keys = df.select("map_id", seq, *same), [F.col(c) for c in same]
    return flat.withColumn("__rank", F.row_number().over(Window.partitionBy("map_id", *keys).orderBy("seq")))


def _late(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Whether a label comes after as many others with its boxes as it has places.

    Each of those others took a place that the ones before it did not take, as a box overlaps itself, or found all of them taken: then so do later ones.
    """
    solid = F.forall(F.zip_with(x0, x1, lambda a, b: a < b), lambda v: v) & F.forall(F.zip_with(y0, y1, lambda a, b: a < b), lambda v: v)
    return solid & (F.col("__rank") > F.size(x0))


def _offered(df: DataFrame, order: str, boxes: Column | None, same: list[str] | None) -> DataFrame:
    """(map_id, seq, four arrays of sides): without places for labels that are late."""
    sides = _sides(boxes)
    late = _late(*sides)
    return _ranked(df, order, same).select("map_id", "seq", *(F.when(late, F.array().cast("array<double>")).otherwise(c).alias(s) for s, c in zip(SIDES, sides, strict=True)))


def _tile_sizes(flat: DataFrame, reaches: DataFrame | None = None) -> DataFrame:
    """flat: map_id, __lx, __ly, __wide; reaches: m, reach, where they are known. Returns map_id, reach (of its widest label), tile: the widest tiles that hold TILE_LABELS labels at most, twice the reach at least; crowd: labels of the fullest tile of that least width."""
    if reaches is None:
        reaches = _small(flat.groupBy("map_id").agg(F.greatest(F.max("__wide"), F.lit(1e-9)).alias("reach")).withColumnRenamed("map_id", "m"))
    cell = lambda low: F.floor(F.col(low) / (2 * F.col("reach")))
    cells = flat.join(reaches, F.col("map_id").eqNullSafe(F.col("m"))).groupBy("map_id", "reach", cell("__lx").alias("cx"), cell("__ly").alias("cy")).agg(F.count("*").alias("n"))
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).groupBy("map_id", "reach", "level", F.expr("shiftright(cx, level) AS cx"), F.expr("shiftright(cy, level) AS cy")).agg(F.sum("n").alias("n"))
    most = levels.groupBy("map_id", "reach", "level").agg(F.max("n").alias("n"))
    widest = F.coalesce(F.max(F.when(F.col("n") <= TILE_LABELS, F.col("level"))), F.lit(0))
    crowd = F.max(F.when(F.col("level") == 0, F.col("n")))
    return most.groupBy("map_id", "reach").agg(widest.alias("level"), crowd.alias("crowd")).select("map_id", "reach", (2 * F.col("reach") * F.pow(F.lit(2.0), "level")).alias("tile"), "crowd")


def _parted(offers: DataFrame, sizes: DataFrame, steps: Steps) -> tuple[DataFrame, int]:
    """Adds __part: the part of its map's order that a label is in, from 0; and how many parts there are. Labels of an order that has no quantiles are one part."""
    orders = isinstance(offers.schema["seq"].dataType, (T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType))
    parts = F.least(F.greatest(F.ceil(F.log(float(STEP), F.col("crowd") / FIRST)), F.lit(0)), F.lit(PARTS)).cast("int")
    most = (sizes.agg(F.max(parts)).first()[0] or 0) if orders else 0
    if not most:
        return offers.withColumn("__part", F.lit(0)), 1
    crowded = sizes.select("m", parts.alias("__parts")).where("__parts > 0")
    cuts = offers.join(F.broadcast(crowded), F.col("map_id").eqNullSafe(F.col("m")), "left_semi").groupBy("map_id").agg(F.percentile_approx("seq", [float(STEP) ** -k for k in range(most, 0, -1)], 10_000).alias("__cuts"))
    cuts = _small(steps.keep(cuts.join(crowded, F.col("map_id").eqNullSafe(F.col("m"))).select("m", F.slice("__cuts", most - F.col("__parts") + 1, F.col("__parts")).alias("__cuts"))))
    at = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("seq"))), F.lit(0))
    return offers.join(cuts, F.col("map_id").eqNullSafe(F.col("m")), "left").withColumn("__part", F.when(F.col("__cuts").isNull(), 0).otherwise(at)).drop("m", "__cuts"), most + 1


def _left_over(offers: DataFrame, sides: list[Column], placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds k: the first place of a label that no placed one overlaps, or the number of its places. All labels of placed come before those of offers in their maps."""
    names = offers.columns
    schema = T.StructType([*offers.schema.fields, T.StructField("k", T.IntegerType())])

    def run(batch: pa.RecordBatch, at: np.ndarray, boxes: list[np.ndarray], others: list[np.ndarray], _) -> pa.RecordBatch:
        n = at[1:] - at[:-1]
        place = np.arange(at[-1]) - np.repeat(at[:-1], n)
        k = np.minimum.reduceat(np.where(overlapped(boxes, others), np.repeat(n, n), place), at[:-1])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(k, pa.int32())], names=[*names, "k"])

    return by_tiles(offers, sides, placed, sizes, run, schema, (F.col("__lx"), F.col("__ly")))


def _rounds(steps: Steps, labels: DataFrame, sizes: DataFrame, placed: DataFrame | None, order_kind: str, types: pa.Schema, rounds: list[int] | None, later: int) -> DataFrame:
    """(map_id, seq, choice, sides) of labels (map_id, seq, k: their first possible place, four arrays of sides), which placed ones (map_id, x0, x1, y0, y1) come before, and `later` labels come after."""
    of_map = lambda d, *more: d.join(sizes, F.col("map_id").eqNullSafe(F.col("m"))).select("map_id", "seq", *more, *SIDES, "reach", "tile")
    waiting, decided = of_map(labels, "k"), None
    fixed = None if placed is None else of_map(placed.withColumns({s: F.array(s) for s in SIDES}), F.lit(0).alias("k"))
    for turn in range(1 << 30):
        shift = SHIFTS[turn % len(SHIFTS)]
        run, schema = _round(dict(labels.dtypes)["map_id"], order_kind, types.field("seq").type, types.field("map_id").type, shift)
        rows = _tiles(waiting, shift).withColumn("role", F.when((F.col("tx") == F.col("ox")) & (F.col("ty") == F.col("oy")), 0).otherwise(1))
        taken = None if decided is None else decided.where("choice >= 0").withColumns({s: F.array(F.get(s, F.col("choice"))) for s in SIDES}).drop("choice")
        if fixed is not None:
            taken = fixed if taken is None else taken.unionByName(fixed)
        if taken is not None:
            tiles = rows.where("role = 0").select(F.col("map_id").alias("m"), F.col("tx").alias("mx"), F.col("ty").alias("my")).distinct()
            near = _tiles(taken, shift).join(tiles, F.col("map_id").eqNullSafe(F.col("m")) & (F.col("tx") == F.col("mx")) & (F.col("ty") == F.col("my")), "left_semi")
            rows = rows.unionByName(near.withColumn("role", F.lit(2)))
        step = steps.keep(rows.drop("ox", "oy").groupBy("map_id", "tx", "ty").applyInArrow(run, schema))
        waiting, done = step.where("choice is null").drop("choice"), step.where("choice is not null")
        decided = done if decided is None else decided.unionByName(done)
        left = waiting.count()
        if rounds is not None:
            rounds.append(left + later)
        if not left:
            return decided


def place_in_rounds(df: DataFrame, order: str = "seq", rounds: list[int] | None = None, boxes: Column | None = None, same: list[str] | None = None) -> DataFrame:
    """df: map_id, a unique order column, boxes (array of candidates). Returns (map_id, order, choice): the candidate's number from 0, -1 for none.

    boxes and same: in place of the column of that name, a function of the columns `same` alone; then only these are shuffled to find copies.
    Labels without candidates get -1; null maps are a map of their own; no labels give no rows. rounds, if given, receives how many labels each round left.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)
    steps, out = Steps(spark), Steps(spark)
    if (boxes is None) != (same is None):
        raise ValueError("boxes and same go together")
    own, sides = list(SIDES) if same is None else same, _sides(boxes)
    ranked = _ranked(df, order, same)
    x0, x1, y0, y1 = sides
    wide = F.greatest(F.array_max(x1) - F.array_min(x0), F.array_max(y1) - F.array_min(y0))
    extent = [F.array_min(x0).alias("__lx"), F.array_min(y0).alias("__ly"), wide.alias("__wide")]
    flat = steps.keep(ranked.select("map_id", "seq", *own, *extent, ((F.size(x0) == 0) | _late(*sides)).alias("__bare")))
    bare = flat.where("__bare").select("map_id", "seq", F.lit(-1).alias("choice"))
    offers = flat.where("not __bare").drop("__bare")
    with_sides = lambda d, *more: d.select("map_id", "seq", *more, *(c.alias(s) for s, c in zip(SIDES, sides, strict=True)))
    sizes = _small(steps.keep(_tile_sizes(offers)).withColumnRenamed("map_id", "m"))
    offers, parts = _parted(offers, sizes, steps)
    types = df.select("map_id", F.col(order).alias("seq")).limit(0).toArrow().schema
    every, placed, tiles = [bare], None, sizes
    for part in range(parts):
        entering = offers.where(F.col("__part") == part).drop("__part")
        if placed is None:
            entering = entering.withColumn("k", F.lit(0))
        else:
            entering = steps.keep(_left_over(entering, sides, placed, sizes))
            every.append(entering.where(F.col("k") == F.size(sides[0])).select("map_id", "seq", F.lit(-1).alias("choice")))
            entering = entering.where(F.col("k") < F.size(sides[0]))
        if parts > 1:
            tiles = _small(steps.keep(_tile_sizes(entering, sizes.select("m", "reach"))).withColumnRenamed("map_id", "m"))
        later = 0 if rounds is None or part == parts - 1 else offers.where(F.col("__part") > part).count()
        done = _rounds(steps, with_sides(entering, "k"), tiles, placed, kind[order], types, rounds, later)
        every.append(done.select("map_id", "seq", "choice"))
        taken = done.where("choice >= 0").select("map_id", "seq", *(F.get(s, F.col("choice")).alias(s) for s in SIDES))
        placed = taken if placed is None else placed.unionByName(taken)
    decided = every[0]
    for e in every[1:]:
        decided = decided.unionByName(e)
    found = out.keep(decided)
    steps.clear()
    return found.withColumnRenamed("seq", order)

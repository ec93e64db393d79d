"""Contour segments joined into lines: within tiles by one task each, then from tile to tile by pointer doubling over what is open at their ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.operators.chains import linked
from isoline.operators.raster_grid import contour_segments
from isoline.sources.steps import Steps


def trails(ends: list[tuple]) -> list[list[tuple[int, bool]]]:
    """Edges (a, b) of a graph as trails that use each edge once: lists of (edge, is it walked backwards). Trails start at nodes of odd degree; what is left are loops."""
    at: dict = {}
    for i, (a, b) in enumerate(ends):
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    used, out = [False] * len(ends), []

    def walk(node) -> None:
        trail = []
        while True:
            while at[node] and used[at[node][-1]]:
                at[node].pop()
            if not at[node]:
                break
            i = at[node].pop()
            used[i] = True
            back = ends[i][0] != node
            trail.append((i, back))
            node = ends[i][0] if back else ends[i][1]
        if trail:
            out.append(trail)

    for node in [n for n, e in at.items() if len(e) % 2]:
        walk(node)
    for node in list(at):
        walk(node)
    return out


def _key(x: float, y: float) -> tuple:
    return round(x, 7), round(y, 7)


def contour_lines(cells: DataFrame, interval: float, base: float = 0.0, nodata: float | None = None, tile: int = 128) -> DataFrame:
    """(raster_id, elev, line, points, closed). Tiles bound what a task stitches; lines that leave their tile are linked in log rounds, whatever their number."""
    def stitch(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["x1", "y1", "x2", "y2"])
        seg = list(zip(frame["x1"], frame["y1"], frame["x2"], frame["y2"]))
        rows = []
        for trail in trails([(_key(a, b), _key(c, d)) for a, b, c, d in seg]):
            i, back = trail[0]
            points = [seg[i][2:] if back else seg[i][:2]] + [seg[i][:2] if back else seg[i][2:] for i, back in trail]
            rows.append(([p[0] for p in points], [p[1] for p in points], _key(*points[0]), _key(*points[-1])))
        first = frame.iloc[0]
        return pd.DataFrame(rows, columns=["xs", "ys", "head", "tail"]).assign(raster_id=first["raster_id"], elev=first["elev"])

    steps, out = Steps(cells.sparkSession), Steps(cells.sparkSession)
    seg = contour_segments(cells, interval, base, nodata).where("x1 <> x2 or y1 <> y2")
    seg = seg.withColumns({"tx": F.floor(F.least("x1", "x2") / tile), "ty": F.floor(F.least("y1", "y2") / tile)})
    kind = dict(cells.dtypes)["raster_id"]
    parts = seg.groupBy("raster_id", "elev", "tx", "ty").applyInPandas(stitch, f"raster_id {kind}, elev double, xs array<double>, ys array<double>, head array<double>, tail array<double>")
    parts = out.keep(parts.select(F.monotonically_increasing_id().alias("part"), "*"))
    whole = parts.where("head = tail")
    open_ = parts.where("head <> tail").select("part", F.posexplode(F.array("head", "tail")).alias("side", "at"), "raster_id", "elev")
    found = out.keep(linked(open_.select("part", "side", F.struct("raster_id", "elev", "at").alias("node")), steps))
    points = F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    both = parts.join(found, "part").select("raster_id", "elev", "line", "place", "closed", F.when(F.col("back"), F.reverse(points)).otherwise(points).alias("p"))
    lines = both.groupBy("raster_id", "elev", "line").agg(F.array_sort(F.collect_list(F.struct("place", "p"))).alias("v"), F.max("closed").alias("closed"))
    rest = F.flatten(F.transform(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), lambda v: F.slice(v["p"], 2, F.greatest(F.size(v["p"]) - 1, F.lit(0)))))
    lines = lines.select("raster_id", "elev", "line", F.concat(F.col("v")[0]["p"], rest).alias("points"), "closed")
    steps.clear()
    return lines.unionByName(whole.select("raster_id", "elev", (2 * F.col("part")).alias("line"), points.alias("points"), F.lit(True).alias("closed")))


def contour_features(lines: DataFrame) -> DataFrame:
    """Contour lines as features with the tags ID and ELEV."""
    from isoline.sources.features import finish

    tags = F.array(F.struct(F.lit("ID").alias("key"), F.col("line").cast("string").alias("value")), F.struct(F.lit("ELEV").alias("key"), F.col("elev").cast("string").alias("value")))
    return finish(lines.select(F.xxhash64("raster_id", "elev", "line").alias("feature_id"), F.lit("line").alias("geom_type"), F.array("points").alias("parts"), tags.alias("tags")))

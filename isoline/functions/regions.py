"""Offsets, buffers and unions of polygons: boundaries of regions given by winding numbers.

All edges are parted where they meet, on a grid of a thousand-millionth of the extent; a piece stays where the region is on one side of it only, and
pieces are joined into rings, outer ones counter-clockwise. Work grows with the square of one region's edges, so this is for regions of up to some
thousand vertices; regions (rows) are independent. Arcs are parts of regular polygons of `arc` corners, so round joins lie inside the true circle by
at most 1 - cos(pi / arc) of the radius. Null or empty regions give null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

Rings = Sequence[np.ndarray]
BLOCK = 512


def edges_of(rings: Rings) -> np.ndarray:
    kept = [np.hstack([r[:-1], r[1:]]) for r in rings if len(r) > 1]
    out = np.concatenate(kept) if kept else np.zeros((0, 4))
    return out[(out[:, :2] != out[:, 2:]).any(axis=1)]


def winding(at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The winding number of edges around each place."""
    out = np.zeros(len(at), int)
    ax, ay, bx, by = edges.T
    for k in range(0, len(at), BLOCK):
        x, y = at[k : k + BLOCK, :1], at[k : k + BLOCK, 1:]
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        out[k : k + BLOCK] = ((ay <= y) & (by > y) & (side > 0)).sum(axis=1) - ((ay > y) & (by <= y) & (side < 0)).sum(axis=1)
    return out


def _pieces(e: np.ndarray, step: float) -> np.ndarray:
    """Edges in whole steps, parted where they meet, each once and without direction."""
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    size = (d * d).sum(axis=1)
    lo, hi = np.minimum(e[:, :2], e[:, 2:]) - step, np.maximum(e[:, :2], e[:, 2:]) + step
    every = np.arange(len(e))
    cuts, places = [every, every], [np.zeros(len(e)), np.ones(len(e))]
    for k in range(0, len(e), BLOCK):
        r = slice(k, k + BLOCK)
        near = (lo[:, 0] <= hi[r, :1]) & (hi[:, 0] >= lo[r, :1]) & (lo[:, 1] <= hi[r, 1:]) & (hi[:, 1] >= lo[r, 1:])
        i, j = np.nonzero(near)
        i += k
        i, j = i[i != j], j[i != j]
        den = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        off = a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (off[:, 0] * d[j, 1] - off[:, 1] * d[j, 0]) / den
            u = (off[:, 0] * d[i, 1] - off[:, 1] * d[i, 0]) / den
        on = (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
        cuts.append(i[on])
        places.append(t[on])
        for end in (e[j, :2], e[j, 2:]):  # ends that lie on an edge
            s = ((end - a[i]) * d[i]).sum(axis=1) / size[i]
            gap = np.abs((end[:, 0] - a[i, 0]) * d[i, 1] - (end[:, 1] - a[i, 1]) * d[i, 0]) / np.sqrt(size[i])
            on = (s > 0) & (s < 1) & (gap <= step)
            cuts.append(i[on])
            places.append(s[on])
    i, t = np.concatenate(cuts), np.concatenate(places)
    order = np.lexsort((t, i))
    i, t = i[order], t[order]
    p = np.rint((a[i] + t[:, None] * d[i]) / step).astype(np.int64)
    on = i[1:] == i[:-1]
    all_ = np.hstack([p[:-1][on], p[1:][on]])
    all_ = all_[(all_[:, :2] != all_[:, 2:]).any(axis=1)]
    turn = (all_[:, 0] > all_[:, 2]) | ((all_[:, 0] == all_[:, 2]) & (all_[:, 1] > all_[:, 3]))
    all_[turn] = all_[turn][:, [2, 3, 0, 1]]
    return np.unique(all_, axis=0)


def turn(way: tuple, on: tuple) -> float:
    """The angle by which `on` turns to the left of `way`."""
    return math.atan2(way[0] * on[1] - way[1] * on[0], way[0] * on[0] + way[1] * on[1])


def bends(p: np.ndarray) -> np.ndarray:
    """The corners of a ring in whole steps (first one not repeated), without those on the straight; none if no region is left."""
    before, after = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 4 * np.maximum(np.hypot(*before.T), np.hypot(*after.T))
    return p[bend] if bend.sum() > 2 else p[:0]


def _rings(pieces: np.ndarray, step: float) -> list[np.ndarray]:
    """Directed pieces as rings; where several go on, the one farthest to the left, so rings that touch stay apart."""
    on: dict[tuple, list[tuple]] = {}
    for x, y, u, v in pieces.tolist():
        on.setdefault((x, y), []).append((u, v))
    out = []
    while on:
        first = next(iter(on))
        ring, way = [first], None
        while True:
            p = ring[-1]
            options = on.get(p)
            if not options:
                break
            if way is None or len(options) == 1:
                q = options[-1]
            else:
                q = max(options, key=lambda o: turn(way, (o[0] - p[0], o[1] - p[1])))
            options.remove(q)
            if not options:
                del on[p]
            way = (q[0] - p[0], q[1] - p[1])
            ring.append(q)
            if q == first:
                break
        if len(ring) > 3 and ring[0] == ring[-1]:
            p = bends(np.array(ring[:-1], float))
            if len(p):
                out.append(np.concatenate([p, p[:1]]) * step)
    return out


def boundary(sets: Sequence[np.ndarray], inside, step: float) -> np.ndarray:
    """Directed pieces (in whole steps) with the region on their left only: all places where inside(winding numbers of each set of edges) holds."""
    p = _pieces(np.concatenate(sets), step)
    a, b = p[:, :2] * step, p[:, 2:] * step
    way = (b - a) / np.hypot(*(b - a).T)[:, None]
    left = np.column_stack([-way[:, 1], way[:, 0]]) * 16 * step
    mid = (a + b) / 2
    on_left, on_right = (inside(*(winding(mid + k * left, s) for s in sets)) for k in (1, -1))
    p[on_right] = p[on_right][:, [2, 3, 0, 1]]
    return p[on_left != on_right]


def region(groups: Sequence[Rings], inside) -> list[np.ndarray]:
    """Rings around all places where inside(winding numbers of each group) holds."""
    sets = [edges_of(g) for g in groups]
    e = np.concatenate(sets)
    if not len(e):
        return []
    origin = np.minimum(e[:, :2], e[:, 2:]).min(axis=0)
    e, sets = e - np.tile(origin, 2), [s - np.tile(origin, 2) for s in sets]
    step = float(np.abs(e).max()) * 1e-9
    return [r + origin for r in _rings(boundary(sets, inside, step), step)]


def capsule(p: np.ndarray, q: np.ndarray, r: float, arc: int) -> np.ndarray:
    """All places within r of the segment pq."""
    along = math.atan2(q[1] - p[1], q[0] - p[0])
    t = along - math.pi / 2 + np.arange(arc // 2 + 1) * (2 * math.pi / arc)
    half = lambda c, turn: c + r * np.column_stack([np.cos(t + turn), np.sin(t + turn)])
    ring = np.concatenate([half(q, 0.0), half(p, math.pi)])
    return np.concatenate([ring, ring[:1]])


def union(rings: Rings) -> list[np.ndarray]:
    return region([rings], lambda w: w > 0)


def buffer_lines(lines: Rings, r: float, arc: int = 24) -> list[np.ndarray]:
    """Lines with round joins and caps; lines of one vertex are points."""
    parts = [capsule(p, q, r, arc) for c in lines for p, q in (zip(c, c[1:]) if len(c) > 1 else [(c[0], c[0])])]
    return union(parts)


def offset_rings(rings: Rings, r: float, arc: int = 24) -> list[np.ndarray]:
    """Larger by r (round joins), or smaller where r is negative; nothing may be left."""
    if r == 0:
        return union(rings)
    rims = [capsule(e[:2], e[2:], abs(r), arc) for e in edges_of(rings)]
    return region([rings, rims], (lambda a, b: (a > 0) | (b > 0)) if r > 0 else (lambda a, b: (a > 0) & (b == 0)))


def _applied(parts: Column, f) -> Column:
    @pandas_udf("struct<xs:array<array<double>>,ys:array<array<double>>>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(x, y, strict=True):
            rings = [] if a is None else f([np.column_stack([np.asarray(u, float), np.asarray(v, float)]) for u, v in zip(a, b, strict=True)])
            out.append(([r[:, 0].tolist() for r in rings], [r[:, 1].tolist() for r in rings]) if rings else (None, None))
        return pd.DataFrame(out, columns=["xs", "ys"], dtype=object)

    got = run(F.transform(parts, lambda c: F.transform(c, lambda p: p["x"])), F.transform(parts, lambda c: F.transform(c, lambda p: p["y"])))
    return F.zip_with(got["xs"], got["ys"], lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))


def offset_polygon(parts: Column, r: float, arc: int = 24) -> Column:
    """Rings of the offset polygon; null where nothing is left."""
    return _applied(parts, lambda rings: offset_rings(rings, r, arc))


def buffer_line(parts: Column, r: float, arc: int = 24) -> Column:
    """Rings around lines or points; r must be positive."""
    if r <= 0:
        raise ValueError("r must be positive")
    return _applied(parts, lambda rings: buffer_lines(rings, r, arc))

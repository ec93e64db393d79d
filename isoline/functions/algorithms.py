"""Sequential geometry as Arrow-batched functions of one row: simplification, adaptive smoothing, pole of inaccessibility, hyphenation.

Rows are independent, so nothing is shuffled. Simplification returns the numbers of the kept vertices only; the vertices themselves stay in the JVM.
Null or empty lines give null or empty results.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _xy(c: Column) -> tuple[Column, Column]:
    return F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"])


def _rows(x: pd.Series, y: pd.Series):
    for a, b in zip(x, y, strict=True):
        yield None if a is None else np.column_stack([np.asarray(a, float), np.asarray(b, float)])


def _take(c: Column, kept: Column) -> Column:
    return F.transform(kept, lambda i: F.get(c, i))


def split_kept(p: np.ndarray, most: int, tolerance: float) -> list[int]:
    """Best-first splitting at the farthest vertex; vertices with NaN part a line and stay."""
    if len(p) < 3 or (most == 0 and tolerance == 0):
        return list(range(len(p)))
    gaps = np.flatnonzero(~np.isfinite(p).all(axis=1)).tolist()
    heap: list[tuple[float, int, int, int]] = []

    def put(a: int, b: int) -> None:
        far, at = 0.0, a
        if b - a > 1:
            d, inner = p[b] - p[a], p[a + 1 : b] - p[a]
            size = float(d @ d)
            if size == 0 and inner.any():
                heapq.heappush(heap, (1.0, a, b, a + 1))  # no chord: last in line, and split at its first vertex
                return
            t = np.clip(inner @ d / (size or 1.0), 0, 1)
            off = np.round(np.hypot(*(inner - t[:, None] * d).T), 9)  # equal distances stay equal, so the first of them is taken
            at = a + 1 + int(off.argmax())
            far = float(off[at - a - 1])
        heapq.heappush(heap, (-far, a, b, at))

    edges = [-1, *gaps, len(p)]
    for a, b in zip(edges, edges[1:]):
        if b - a > 1:
            put(a + 1, b - 1)
    while heap and len(heap) + len(gaps) < max(most, 3) - 1:
        key, a, b, at = heap[0]
        if -key <= tolerance and key <= 0:
            break
        if at in (a, b):
            break
        heapq.heappop(heap)
        put(a, at)
        put(at, b)
    return sorted({i for _, a, b, _ in heap for i in (a, b)} | set(gaps))


def small_triangles_kept(p: np.ndarray, most: int, tolerance: float) -> list[int]:
    """Removes the vertex of the smallest triangle while it is below the tolerance and more than `most` (at least 3) vertices are left; ends stay."""
    n = len(p)
    if n <= 3:
        return list(range(n))
    before, after, alive, current = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n, [math.inf] * n
    heap: list[tuple[float, int]] = []

    def weigh(i: int) -> None:
        if 0 < i < n - 1:
            (ax, ay), (bx, by), (cx, cy) = p[before[i]], p[i], p[after[i]]
            current[i] = abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2
            heapq.heappush(heap, (current[i], i))

    for i in range(1, n - 1):
        weigh(i)
    left, least = n, max(most, 3)
    while heap and left > least:
        size, i = heapq.heappop(heap)
        if not alive[i] or size != current[i]:
            continue
        if size >= tolerance:
            break
        alive[i], left = False, left - 1
        after[before[i]], before[after[i]] = after[i], before[i]
        weigh(before[i])
        weigh(after[i])
    return [i for i in range(n) if alive[i]]


def _simplifier(f, most: int, tolerance: float):
    @pandas_udf("array<int>")
    def kept(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else f(p, most, tolerance) for p in _rows(x, y)], dtype=object)

    return kept


def douglas_peucker(c: Column, most: int = 2**31 - 1, tolerance: float = 0.0) -> Column:
    """At most `most` vertices, farthest from their chord first, down to the tolerance."""
    return _take(c, _simplifier(split_kept, most, float(tolerance))(*_xy(c)))


def visvalingam_whyatt(c: Column, most: int = 3, tolerance: float = math.inf) -> Column:
    return _take(c, _simplifier(small_triangles_kept, most, float(tolerance))(*_xy(c)))


def smooth_points(p: np.ndarray, closed: bool, limit: float) -> np.ndarray:
    """Cuts corners, round after round, until no turn is above twice the limit (radians). Vertices of a ring's seam are cut like the others."""
    while len(p) > 2:
        q = p[:-1] if closed else p
        d, e = q - np.roll(q, 1, axis=0), np.roll(q, -1, axis=0) - q
        with np.errstate(invalid="ignore", divide="ignore"):
            turn = np.arccos((d * e).sum(axis=1) / (np.hypot(*d.T) * np.hypot(*e.T)))
        cut = turn > 2 * limit
        if not closed:
            cut[0] = cut[-1] = False
        if not cut.any():
            break
        first, second = q - 0.25 * d, q + 0.25 * e
        out = np.stack([np.where(cut[:, None], first, q), second], axis=1).reshape(-1, 2)[np.column_stack([np.ones(len(q), bool), cut]).ravel()]
        p = np.concatenate([out[1:], out[:1], out[1:2]]) if closed and cut[0] else np.concatenate([out, out[:1]]) if closed else out
    return p


def smooth_lines(p: np.ndarray, ends: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """smooth_points of many open lines (vertices one after the other, and where each line ends) in rounds over all lines that still turn; (vertices, ends)."""
    n = len(ends)
    line = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(p):
        edge = np.append(line[1:] != line[:-1], True)
        last, first = edge, np.append(True, edge[:-1])
        d = p - np.roll(p, 1, axis=0)
        e = np.roll(d, -1, axis=0)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            turn = np.arccos((d * e).sum(axis=1) / (np.hypot(*d.T) * np.hypot(*e.T)))
        cut = (turn > 2 * limit) & ~first & ~last
        open_ = np.zeros(n, bool)
        open_[line[cut]] = True
        goes = open_[line]
        done.append((line[~goes], p[~goes]))
        before, after = p - 0.25 * d, p + 0.25 * e
        out = np.stack([np.where(cut[:, None], before, p), after], axis=1).reshape(-1, 2)
        kept = np.column_stack([goes, goes & cut]).ravel()
        p, line = out[kept], np.repeat(line, 2)[kept]
    if not done:
        return p, ends
    line, p = np.concatenate([k for k, _ in done]), np.concatenate([q for _, q in done])
    order = np.argsort(line, kind="stable")
    return p[order], np.cumsum(np.bincount(line, minlength=n))


#: Vertices of open lines that are smoothed at once, about.
VERTICES = 50_000


def _smoothed(x: pd.Series, y: pd.Series, limit: float) -> list:
    out: list = [None] * len(x)
    rows, held = [], 0
    for k, p in enumerate(_rows(x, y)):
        if p is not None:
            rows.append((k, p))
            held += len(p)
        if rows and (held >= VERTICES or k == len(x) - 1):
            q, ends = smooth_lines(np.concatenate([p for _, p in rows]), np.cumsum([len(p) for _, p in rows]), limit)
            flat = q.ravel()
            for (i, _), a, b in zip(rows, np.append(0, ends[:-1]), ends):
                out[i] = flat[2 * a : 2 * b]
            rows, held = [], 0
    return out


def chaikin_adaptive(c: Column, max_degrees: float, closed: bool = False) -> Column:
    if max_degrees <= 0:
        raise ValueError("max_degrees must be positive")

    @pandas_udf("array<double>")
    def smooth(x: pd.Series, y: pd.Series) -> pd.Series:
        limit = math.radians(max_degrees)
        if closed:
            return pd.Series([None if p is None else smooth_points(p, closed, limit).ravel().tolist() for p in _rows(x, y)], dtype=object)
        return pd.Series(_smoothed(x, y, limit), dtype=object)

    return _points(smooth(*_xy(c)))


def _points(flat: Column) -> Column:
    """x, y, x, y, ... as points."""
    xs, ys = F.filter(flat, lambda _, i: i % 2 == 0), F.filter(flat, lambda _, i: i % 2 == 1)
    return F.zip_with(xs, ys, lambda a, b: F.struct(a.alias("x"), b.alias("y")))


#: Places that are weighed against all edges at once, at most.
CELLS = 256


def pole(rings: Sequence[np.ndarray], precision: float | None = None) -> tuple[float, float, float]:
    """The place farthest from all outlines, within precision (2 % of the larger side), and its distance; best cells first."""
    edges = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings if len(r) > 1])
    a, b = edges[:, :2], edges[:, 2:]
    d = b - a
    size = np.maximum((d * d).sum(axis=1), 1e-300)
    lo, hi = rings[0].min(axis=0), rings[0].max(axis=0)
    w, h = hi - lo
    side = min(w, h)
    if side <= 0:
        return float(lo[0]), float(lo[1]), 0.0
    goal = 0.02 * max(w, h) if precision is None else precision

    def off(q: np.ndarray) -> list[float]:
        t = np.clip(((q[:, None] - a) * d).sum(axis=2) / size, 0, 1)
        gap = a + t[:, :, None] * d - q[:, None]
        near = np.hypot(gap[:, :, 0], gap[:, :, 1]).min(axis=1)
        x, y = q[:, :1], q[:, 1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = (((a[:, 1] > y) != (b[:, 1] > y)) & (x < d[:, 0] * (y - a[:, 1]) / d[:, 1] + a[:, 0])).sum(axis=1) % 2
        return np.where(inside == 1, near, -near).tolist()

    r = rings[0]
    k = r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]
    mid = ((r[:-1] + r[1:]) * k[:, None]).sum(axis=0) / (3 * k.sum()) if k.sum() else r[0]
    first = np.array([mid, (lo + hi) / 2])
    best = max(((here, x, y) for here, (x, y) in zip(off(first), first)), key=lambda c: c[0])
    heap = []

    def put(places: list[tuple[float, float]], half: float) -> None:
        nonlocal best
        for here, (x, y) in zip(off(np.array(places)), places):
            if here > best[0]:
                best = (here, x, y)
            heapq.heappush(heap, (-(here + half * math.sqrt(2)), x, y, half))

    for i in range(math.ceil(w / side)):
        rows = math.ceil(h / side)
        for j in range(0, rows, CELLS):
            put([(lo[0] + (i + 0.5) * side, lo[1] + (n + 0.5) * side) for n in range(j, min(rows, j + CELLS))], side / 2)
    while heap:
        top, x, y, half = heapq.heappop(heap)
        if -top - best[0] <= goal:
            break
        put([(x + dx * half, y + dy * half) for dx in (-0.5, 0.5) for dy in (-0.5, 0.5)], half / 2)
    return float(best[1]), float(best[2]), best[0]


def pole_of_inaccessibility(parts: Column, precision: float | None = None) -> Column:
    """struct<x, y, distance> for rings (array of arrays of points), the first of which bounds the search. Of rings that are alike, a batch weighs one."""
    @pandas_udf("array<double>")
    def find(x: pd.Series, y: pd.Series) -> pd.Series:
        out, known = [], {}
        for a, b in zip(x, y, strict=True):
            rings = None if a is None else [np.column_stack([np.asarray(u, float), np.asarray(v, float)]) for u, v in zip(a, b, strict=True)]
            if not rings or len(rings[0]) < 2:
                out.append(None)
                continue
            key = tuple(r.tobytes() for r in rings)
            if key not in known:
                known[key] = list(pole(rings, precision))
            out.append(known[key])
        return pd.Series(out, dtype=object)

    at = find(F.transform(parts, lambda c: F.transform(c, lambda p: p["x"])), F.transform(parts, lambda c: F.transform(c, lambda p: p["y"])))
    return F.when(at.isNotNull(), F.struct(F.get(at, F.lit(0)).alias("x"), F.get(at, F.lit(1)).alias("y"), F.get(at, F.lit(2)).alias("distance")))


#: The key of a trie's node under which the digits of a pattern that ends there stand.
DIGITS = ""


def hyphenation_tables(patterns: Iterable[str], exceptions: Iterable[str] = ()) -> tuple[dict, dict[str, list[int]]]:
    """Liang's patterns ("hy3ph") as a trie of letters with digits at its nodes, and exceptions ("ta-ble") as words to break places."""
    trie: dict = {}
    for text in patterns:
        node, digits = trie, [0]
        for ch in text.strip():
            if ch.isdigit():
                digits[-1] = int(ch)
            else:
                node = node.setdefault(ch, {})
                digits.append(0)
        if node is not trie:
            node[DIGITS] = digits
    known = {}
    for text in exceptions:
        parts = text.strip().lower().split("-")
        if "".join(parts):
            known["".join(parts)] = np.cumsum([len(s) for s in parts[:-1]]).tolist()
    return trie, known


def breaks(word: str, tables: tuple, left: int = 2, right: int = 3) -> list[int]:
    """The places inside a word where it may be parted."""
    trie, known = tables
    low = word.lower()
    if low in known:
        return known[low]
    text, values = f".{low}.", [0] * (len(low) + 3)
    for i in range(len(text)):
        node = trie
        for ch in text[i:]:
            node = node.get(ch)
            if node is None:
                break
            for k, v in enumerate(node.get(DIGITS, ()), i):
                if v > values[k]:
                    values[k] = v
    return [i for i in range(left, len(low) - right + 1) if values[i + 1] % 2]


_WORD = re.compile(r"[^\W\d_]+")


def parted(text: str, tables: tuple, separator: str, left: int, right: int) -> str:
    def part(m: re.Match) -> str:
        w, at = m.group(), [0, *breaks(m.group(), tables, left, right), len(m.group())]
        return separator.join(w[i:j] for i, j in zip(at, at[1:]))

    return _WORD.sub(part, text)


def hyphenate(text: Column, patterns: Sequence[str], exceptions: Sequence[str] = (), separator: str = "|", left: int = 2, right: int = 3) -> Column:
    """separator at every possible break of the text's words. Patterns are a language's list; `sources.hyphenation` reads files of them."""
    tables = hyphenation_tables(patterns, exceptions)

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else parted(t, tables, separator, left, right))

    return run(text)

"""Units and the fit of map bounds into a canvas: driver arithmetic that becomes literals in the affine transform."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed value: pixels an inch.
DPI = 90.0
_POINTS = {"inch": 72.0, "mm": 72.0 / 25.4, "pixel": 72.0 / DPI, "point": 1.0}


def convert(value: float, source: str, target: str) -> float:
    return value * _POINTS[source] / _POINTS[target]


@dataclass(frozen=True)
class Fit:
    """Actual bounds, and x' = x * scale + offset for both axes."""

    box: tuple[float, float, float, float]
    scale_x: float
    scale_y: float
    offset_x: float
    offset_y: float


def fit(box: tuple, width: float, height: float, strategy: str = "extend") -> Fit:
    """strategy, where the shapes differ: stretch distorts; center leaves margins; crop shows less; extend shows more."""
    x0, x1, y0, y1 = (float(v) for v in box)
    w, h = x1 - x0, y1 - y0
    if min(w, h, width, height) <= 0:
        raise ValueError("bounds and canvas must have a size")
    ours, theirs = w / h, width / height
    used_w, used_h = float(width), float(height)
    if strategy == "center":
        used_w, used_h = (width * ours / theirs, used_h) if ours < theirs else (used_w, height * theirs / ours)
    elif strategy in ("crop", "extend"):
        wider = (ours < theirs) == (strategy == "extend")  # the box's width changes, not its height
        new_w, new_h = (h * theirs, h) if wider else (w, w / theirs)
        x0, x1, y0, y1 = (x0 + x1 - new_w) / 2, (x0 + x1 + new_w) / 2, (y0 + y1 - new_h) / 2, (y0 + y1 + new_h) / 2
    elif strategy != "stretch":
        raise ValueError(f"no strategy {strategy}")
    sx, sy = used_w / (x1 - x0), used_h / (y1 - y0)
    return Fit((x0, x1, y0, y1), sx, sy, (width - used_w) / 2 - x0 * sx, (height - used_h) / 2 - y0 * sy)

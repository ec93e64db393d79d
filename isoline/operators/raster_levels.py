"""Level tables: a transfer function sampled on the driver, applied to cells in 0 .. 1 by linear interpolation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def table(f: Callable[[float], float], size: int = 256) -> list[float]:
    """f at n / (size - 1)."""
    return [float(f(k / (size - 1))) for k in range(size)]


def identity(size: int = 256) -> list[float]:
    return table(lambda v: v, size)


def scaled(k: float, size: int = 256) -> list[float]:
    return table(lambda v: v * k, size)


def quantized(steps: int, size: int = 1024) -> list[float]:
    """Rounded to the nearest of steps + 1 levels k / steps."""
    return table(lambda v: int(v * steps + 0.5) / steps, size)


def midpoint(m: float, size: int = 256) -> list[float]:
    """The power curve that takes m to one half's place: v ** (ln m / ln 0.5)."""
    e = math.log(m) / math.log(0.5)
    return table(lambda v: v**e, size)


def scaled_and_clamped(middle: float, k: float, size: int = 256) -> list[float]:
    """Stretched by k around middle, kept in 0 .. 1."""
    return table(lambda v: min(max((v - middle) * k + middle, 0.0), 1.0), size)


def apply(values: Sequence[float]):
    """The place in the table is (length + 0.5) * v, cut towards zero; places past an end take the end's value."""
    n = len(values)

    def level(v: Column) -> Column:
        lit = F.array(*(F.lit(float(x)) for x in values))
        at = v * (n + 0.5)
        i = F.when(at < 0, F.ceil(at)).otherwise(F.floor(at)).cast("int")
        a, b = F.get(lit, i), F.get(lit, i + 1)
        return F.when(i < 0, F.lit(float(values[0]))).when(i >= n - 1, F.lit(float(values[-1]))).otherwise(a + (b - a) * (at - i))

    return level

"""Rectangle expressions over columns x0, y0, x1, y1 (with a prefix where two meet)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = (0.0, 0.0, 612.0, 792.0)
Rect = tuple[Column, Column, Column, Column]


def rect(prefix: str = "") -> Rect:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def width(r: Rect) -> Column:
    return r[2] - r[0]


def height(r: Rect) -> Column:
    return r[3] - r[1]


def area(r: Rect) -> Column:
    return F.greatest(F.lit(0.0), width(r)) * F.greatest(F.lit(0.0), height(r))


def intersect(a: Rect, b: Rect) -> Rect:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def clip(r: Rect, page: tuple = PAGE) -> Rect:
    return intersect(r, tuple(F.lit(float(v)) for v in page))


def pad(r: Rect, by: float) -> Rect:
    return r[0] - by, r[1] - by, r[2] + by, r[3] + by


def overlap_fraction(a: Rect, b: Rect) -> Column:
    """Share of ``a`` that ``b`` covers; an ``a`` without area has none."""
    return F.when(area(a) > 0, area(intersect(a, b)) / area(a)).otherwise(0.0)


def touches(a: Rect, b: Rect, padding: float) -> Column:
    """Whether the gap in both directions is ``padding`` at most; lines count too."""
    return (a[0] - padding <= b[2]) & (b[0] - padding <= a[2]) & (a[1] - padding <= b[3]) & (b[1] - padding <= a[3])


def is_chromatic(fill: Column, tolerance: float = 0.03) -> Column:
    """Whether a fill has a hue; no fill and grey have none."""
    return F.coalesce(F.array_max(fill) - F.array_min(fill) > tolerance, F.lit(False))


def named(r: Rect) -> list[Column]:
    return [c.alias(n) for c, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)]

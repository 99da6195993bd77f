"""Boxes as four numeric columns x0, y0, x1, y1. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least area, strokes, density and text height of a detection, its largest share of the frame;
#: the height a text line is scaled to, the bounds of the scale, the longest side; line heights where little or nothing is known.
GATES = {"area": 120, "strokes": 2, "density": 0.05, "height": 14, "share": 0.06}
TEXT_HEIGHT, SCALES, LONGEST_SIDE, LEAST_LINE, UNKNOWN_LINE = 80.0, (1.0, 6.0), 960.0, 8.0, 25.0
Box = tuple[Column, Column, Column, Column]


def box(prefix: str) -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where they don't meet."""
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    both = width * height
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def overlaps(a: Box, b: Box) -> Column:
    """Closed boxes: touching counts."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def padded_crop(b: Box, width: Column, height: Column) -> Column:
    """The box with a margin (15 % of its width, 40 % of its height, 10 more), within the frame, as a struct; null if nothing is left."""
    dx = ((b[2] - b[0]) * 0.15).cast("int") + 10
    dy = ((b[3] - b[1]) * 0.4).cast("int") + 10
    x0, y0, x1, y1 = F.greatest(b[0] - dx, F.lit(0)), F.greatest(b[1] - dy, F.lit(0)), F.least(b[2] + dx, width), F.least(b[3] + dy, height)
    return F.when((x1 > x0) & (y1 > y0), F.struct(*(c.cast("int").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True))))


def zone(shares: Box, width: Column, height: Column, whole: bool) -> Box:
    """A zone given by shares of the frame, in pixels: cut to whole ones where rows are detected, as they are where entities are linked."""
    px = [s * n for s, n in zip(shares, (width, height) * 2, strict=True)]
    return tuple(p.cast("int") for p in px) if whole else tuple(px)


def zone_shares(b: Box, width: Column, height: Column) -> Box:
    """A box in pixels as shares of the frame, of four places."""
    return tuple(F.round(c / n, 4) for c, n in zip(b, (width, height) * 2, strict=True))


def detected(area_: Column, strokes: Column, b: Box, frame: Column, density: Column, height: Column, within: Box) -> Column:
    """Whether a group of strokes is a detection: large, of several strokes, not empty, a small and dense part of the frame, high enough, and in the zone."""
    size = area(b)
    return (area_ >= GATES["area"]) & (strokes >= GATES["strokes"]) & (size > 0) & (size / frame <= GATES["share"]) & (density >= GATES["density"]) & (height >= GATES["height"]) & overlaps(b, within)


def scale_factor(ink_height: Column, width: Column, height: Column) -> Column:
    """What a crop of two lines is scaled by so that a line has the wanted height and no side is too long."""
    line = F.when(ink_height.isNull(), UNKNOWN_LINE).otherwise(F.greatest(ink_height / 2, F.lit(LEAST_LINE)))
    factor = F.least(F.greatest(F.lit(TEXT_HEIGHT) / line, F.lit(SCALES[0])), F.lit(SCALES[1]))
    side = F.greatest(width, height) * factor
    return F.when(side > LONGEST_SIDE, factor * LONGEST_SIDE / side).otherwise(factor)

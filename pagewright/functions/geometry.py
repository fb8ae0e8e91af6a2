"""Geometry of axis-aligned boxes as column expressions. Y points down; boxes are x, y, width, height.

Tolerances differ by use and aren't merged: 0.01 pt at page bounds, 1 pt in grids, 1e-9 for normalised containment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_TOLERANCE = 0.01
GRID_TOLERANCE = 1.0
UNIT_TOLERANCE = 1e-9
FRAME_FRACTION = 0.9


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class Box:
    """A box whose sides are columns, names of columns or numbers."""

    x: Column | str | float
    y: Column | str | float
    w: Column | str | float
    h: Column | str | float

    def __post_init__(self) -> None:
        for side in "xywh":
            object.__setattr__(self, side, _c(getattr(self, side)))

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """The columns <prefix>x, <prefix>y, <prefix>w, <prefix>h."""
        return cls(*(f"{prefix}{s}" for s in "xywh"))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def center(self) -> tuple[Column, Column]:
        return self.x + self.w / 2, self.y + self.h / 2

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.w.alias("w"), self.h.alias("h"))


def points(pixels: Column, dpi: Column) -> Column:
    return F.round(pixels * 72 / dpi, 6)


def point_box(b: Box, dpi_x: Column, dpi_y: Column) -> Box:
    """Pixels to points; edges are rounded first, so width is the difference of rounded edges."""
    left, top = points(b.x, dpi_x), points(b.y, dpi_y)
    return Box(left, top, F.round(points(b.right, dpi_x) - left, 6), F.round(points(b.bottom, dpi_y) - top, 6))


def unit_box(b: Box, page_w: Column, page_h: Column) -> Box:
    """A share of the page, at least one unit wide and high, moved inside the page."""
    w = F.least(F.lit(1.0), F.greatest(b.w / page_w, F.least(1 / page_w, F.lit(1.0))))
    h = F.least(F.lit(1.0), F.greatest(b.h / page_h, F.least(1 / page_h, F.lit(1.0))))
    return Box(F.least(F.greatest(b.x / page_w, F.lit(0.0)), 1 - w), F.least(F.greatest(b.y / page_h, F.lit(0.0)), 1 - h), w, h)


def plain_unit_box(b: Box, page_w: Column, page_h: Column) -> Column:
    """A share of the page as a struct; null for a box without extent."""
    return F.when((b.w > 0) & (b.h > 0), Box(b.x / page_w, b.y / page_h, b.w / page_w, b.h / page_h).struct())


def has_point(b: Box, x: Column, y: Column, tolerance: float = 0.0) -> Column:
    """Closed box with a tolerance."""
    return (x >= b.x - tolerance) & (x <= b.right + tolerance) & (y >= b.y - tolerance) & (y <= b.bottom + tolerance)


def has_center(outer: Box, inner: Box) -> Column:
    return has_point(outer, *inner.center)


def has_pixel_center(outer: Box, inner: Box) -> Column:
    """Half-open pixel box; the centre of w pixels from x on is x + (w - 1) / 2."""
    x, y = inner.x + (inner.w - 1) / 2, inner.y + (inner.h - 1) / 2
    return (x >= outer.x) & (x < outer.right) & (y >= outer.y) & (y < outer.bottom)


def has_box(outer: Box, inner: Box, tolerance: float = 0.0) -> Column:
    return (inner.x >= outer.x - tolerance) & (inner.y >= outer.y - tolerance) & (inner.right <= outer.right + tolerance) & (inner.bottom <= outer.bottom + tolerance)


def strictly_has(outer: Box, inner: Box) -> Column:
    return (inner.area < outer.area - 0.01) & has_box(outer, inner, GRID_TOLERANCE)


def inside_page(b: Box, page_w: Column, page_h: Column, tolerance: float = 0.0) -> Column:
    return has_box(Box(0, 0, page_w, page_h), b, tolerance)


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start))


def row_overlap(a: Box, b: Box) -> Column:
    """Shared height over the smaller height."""
    return overlap(a.y, a.bottom, b.y, b.bottom) / F.least(a.h, b.h)


def shared_area(a: Box, b: Box) -> Column:
    return overlap(a.x, a.right, b.x, b.right) * overlap(a.y, a.bottom, b.y, b.bottom)


def shared_fraction(a: Box, b: Box) -> Column:
    """Share of the first box that the second covers."""
    return F.when(a.area > 0, shared_area(a, b) / a.area).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    union = a.area + b.area - shared_area(a, b)
    return F.when(union > 0, shared_area(a, b) / union).otherwise(0.0)


def box_similarity(a: Box, b: Box) -> Column:
    """0.7 of intersection over union and 0.3 of nearness of centres, on unit boxes."""
    (ax, ay), (bx, by) = a.center, b.center
    far = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    return iou(a, b) * 0.7 + F.greatest(F.lit(0.0), 1 - far / F.sqrt(F.lit(2.0))) * 0.3


def nearly_same(a: Box, b: Box) -> Column:
    return (iou(a, b) >= 0.75) | (shared_area(a, b) / F.least(a.area, b.area) >= 0.92)


def direction(a: Box, b: Box) -> tuple[Column, Column]:
    """Dominant axis (horizontal, vertical or null) from a to b and its sign."""
    (ax, ay), (bx, by) = a.center, b.center
    dx, dy = bx - ax, by - ay
    still = (F.abs(dx) <= 1e-12) & (F.abs(dy) <= 1e-12)
    level = F.abs(dx) >= F.abs(dy)
    axis = F.when(~still, F.when(level, F.lit("horizontal")).otherwise(F.lit("vertical")))
    sign = F.when(still, 0).when(F.when(level, dx).otherwise(dy) > 0, 1).otherwise(-1)
    return axis, sign


def directed_gap(a: Box, b: Box, axis: Column, sign: Column) -> Column:
    level = F.when(sign > 0, b.x - a.right).otherwise(a.x - b.right)
    upright = F.when(sign > 0, b.y - a.bottom).otherwise(a.y - b.bottom)
    return F.greatest(F.lit(0.0), F.when(axis == "horizontal", level).otherwise(upright))


def adjacency_kept(ref_a: Box, ref_b: Box, a: Box, b: Box) -> Column:
    """Same dominant direction, and a gap of at most the reviewed one and the larger of 0.05 and itself more."""
    (axis, sign), (axis2, sign2) = direction(ref_a, ref_b), direction(a, b)
    gap = directed_gap(ref_a, ref_b, axis, sign)
    same = (axis == axis2) & (sign == sign2)
    return F.coalesce(same & (directed_gap(a, b, axis2, sign2) <= gap + F.greatest(F.lit(0.05), gap)), F.lit(False))


def gap_crossed(x: Column, y1: Column, y2: Column, a: Box, b: Box) -> Column:
    """A vertical line stands in the gap between two boxes of a row and spans the height that they share."""
    top, bottom = F.greatest(a.y, b.y), F.least(a.bottom, b.bottom)
    return (b.x >= a.right) & (x >= a.right) & (x <= b.x) & (F.least(y1, y2) <= top) & (F.greatest(y1, y2) >= bottom)


def is_level(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x2 - x1) >= F.abs(y2 - y1)


@dataclass(frozen=True)
class Line:
    """A line from (x1, y1) to (x2, y2)."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Line:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def level(self) -> Column:
        return is_level(self.x1, self.y1, self.x2, self.y2)

    @property
    def at(self) -> Column:
        """The coordinate that the line keeps."""
        return F.when(self.level, (self.y1 + self.y2) / 2).otherwise((self.x1 + self.x2) / 2)

    @property
    def start(self) -> Column:
        return F.when(self.level, F.least(self.x1, self.x2)).otherwise(F.least(self.y1, self.y2))

    @property
    def end(self) -> Column:
        return F.when(self.level, F.greatest(self.x1, self.x2)).otherwise(F.greatest(self.y1, self.y2))


def on_page_frame(line: Line, page_w: Column, page_h: Column) -> Column:
    edge = F.when(line.level, F.least(F.abs(line.at), F.abs(line.at - page_h))).otherwise(F.least(F.abs(line.at), F.abs(line.at - page_w)))
    return (edge <= GRID_TOLERANCE) & ((line.end - line.start) / F.when(line.level, page_w).otherwise(page_h) >= FRAME_FRACTION)


def _sides(line: Line, b: Box) -> tuple[Column, Column, Column, Column]:
    """Of a box across a line: its two edges along the line's direction, then where it starts and ends along it."""
    return (
        F.when(line.level, b.y).otherwise(b.x), F.when(line.level, b.bottom).otherwise(b.right),
        F.when(line.level, b.x).otherwise(b.y), F.when(line.level, b.right).otherwise(b.bottom),
    )


def meets_table(line: Line, b: Box) -> Column:
    low, high, start, end = _sides(line, b)
    return (line.at >= low - GRID_TOLERANCE) & (line.at <= high + GRID_TOLERANCE) & (overlap(line.start, line.end, start, end) > 0)


def supports_edge(line: Line, b: Box) -> Column:
    low, high, start, end = _sides(line, b)
    return (F.least(F.abs(line.at - low), F.abs(line.at - high)) <= GRID_TOLERANCE) & (overlap(line.start, line.end, start, end) > 0)


def covers_page(b: Box, page_w: Column, page_h: Column, source_w: Column, source_h: Column, pixel_w: Column, pixel_h: Column) -> Column:
    """At least 0.9 of the page's area, or the page's own pixel size with both sides at 0.75 or more."""
    same = (pixel_w == source_w) & (pixel_h == source_h)
    return (b.area / (page_w * page_h) >= FRAME_FRACTION) | F.coalesce(same & (b.w / page_w >= 0.75) & (b.h / page_h >= 0.75), F.lit(False))


def clipped(b: Box, width: Column, height: Column) -> Box:
    """The part inside a crop; w or h of 0 or less means that nothing is left."""
    x, y = F.greatest(F.lit(0), b.x), F.greatest(F.lit(0), b.y)
    return Box(x, y, F.least(width, b.right) - x, F.least(height, b.bottom) - y)


def unpadded(b: Box, padding: Column, width: Column, height: Column) -> Box:
    """A box of a padded crop in the crop without padding."""
    return clipped(Box(b.x - padding, b.y - padding, b.w, b.h), width, height)


def to_source(b: Box, scale_x: Column, scale_y: Column, left: Column, top: Column, width: Column, height: Column) -> Box:
    """From working pixels (crop scaled) to source pixels: edges floor and ceil, clamp to the crop, add its offset."""
    x1, y1 = F.greatest(F.lit(0), F.floor(b.x / scale_x)), F.greatest(F.lit(0), F.floor(b.y / scale_y))
    x2, y2 = F.least(width, F.ceil(b.right / scale_x)), F.least(height, F.ceil(b.bottom / scale_y))
    return Box(left + x1, top + y1, x2 - x1, y2 - y1)


def scaled_side(side: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(side * scale + 0.5)).cast("int")


def unit(x: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 6)


def line_score(occupancy: Column, share: Column) -> Column:
    """Of a line candidate: how much of it is ink, and how long it is against the page."""
    return unit(F.lit(0.55) + occupancy * 0.25 + F.least(F.lit(1.0), share * 4) * 0.2)


def is_raw_line(length: Column, thickness: Column, shortest: float, thickest: float) -> Column:
    return (length >= shortest) & (thickness <= thickest) & (length >= thickness * 4)

"""Boxes as four double columns: derived values, overlap, distance and filters, all guarded against empty areas."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from quirefold.config import SIMILAR_OVERLAP, SIMILAR_SIZE, LayoutConfig


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def center_y(self) -> Column:
        return (self.y0 + self.y1) / 2


def box(alias: str = "", suffix: str = "") -> Box:
    return Box(*(F.col(f"{alias}{'.' * bool(alias)}{c}{suffix}") for c in ("x0", "y0", "x1", "y1")))


def box_of(values: Column) -> Box:
    """From an array of four numbers; any other length gives nulls."""
    return Box(*(F.when(F.size(values) == 4, F.get(values, i)).cast("double") for i in range(4)))


def pixels(points: Column) -> Column:
    return (points / 72 * 96).cast("long")


def overlaps(a: Box, b: Box) -> Column:
    """Whether two boxes share an area; touching edges do not count."""
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """Division with 0 for what cannot be divided: the optimizer may evaluate it before the test that guards it."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = a.area + b.area - inter
    return F.when(union > 0, ratio(inter, union)).otherwise(0.0)


def size_difference(a: Box, b: Box) -> Column:
    return ratio(F.abs(a.area - b.area), F.greatest(a.area, b.area))


def similar(a: Box, b: Box, least: float = SIMILAR_OVERLAP, most: float = SIMILAR_SIZE) -> Column:
    """High overlap and about the same size; a second box without area is never similar."""
    return overlaps(a, b) & (iou(a, b) >= least) & (size_difference(a, b) <= most) & (b.area != 0)


def smaller_share(a: Box, b: Box) -> Column:
    return ratio(intersection(a, b), F.least(a.area, b.area))


def distance(a: Box, b: Box) -> Column:
    """Euclidean gap between edges; the more negative of both gaps where the boxes overlap."""
    dx = F.greatest(b.x0 - a.x1, a.x0 - b.x1)
    dy = F.greatest(b.y0 - a.y1, a.y0 - b.y1)
    x, y = F.greatest(dx, F.lit(0.0)), F.greatest(dy, F.lit(0.0))
    return F.when((dx < 0) & (dy < 0), F.least(dx, dy)).otherwise(F.sqrt(x * x + y * y))


def contains(outer: Box, inner: Box) -> Column:
    return (inner.x0 >= outer.x0) & (inner.y0 >= outer.y0) & (inner.x1 <= outer.x1) & (inner.y1 <= outer.y1)


def center_inside(outer: Box, inner: Box) -> Column:
    return inner.center_x.between(outer.x0, outer.x1) & inner.center_y.between(outer.y0, outer.y1)


def large_enough(b: Box, least_px: int) -> Column:
    return (pixels(b.width) >= least_px) | (pixels(b.height) >= least_px)


def safe_area(width: Column, height: Column, c: LayoutConfig) -> Box:
    return Box(width * c.margin_left, height * c.margin_top, width * c.margin_right, height * c.margin_bottom)


def center_in_margin(b: Box, width: Column, height: Column, c: LayoutConfig) -> Column:
    """Whether the center lies outside the safe area."""
    return ~center_inside(safe_area(width, height, c), b) if c.enable_margin_check else F.lit(False)


def touches_margin(b: Box, width: Column, height: Column, c: LayoutConfig) -> Column:
    """Whether any part lies outside the safe area."""
    return ~contains(safe_area(width, height, c), b) if c.enable_margin_check else F.lit(False)


def covers_page(b: Box, width: Column, height: Column, share: float) -> Column:
    return (width > 0) & (height > 0) & (b.width >= width * share) & (b.height >= height * share)


def clamp(b: Box, width: Column, height: Column, padding: float) -> Box:
    """A rendering area: the box with padding, within the page."""
    return Box(F.greatest(F.lit(0.0), b.x0 - padding), F.greatest(F.lit(0.0), b.y0 - padding), F.least(width, b.x1 + padding), F.least(height, b.y1 + padding))


def media_name(stem: Column, page: Column, kind: str, number: Column) -> Column:
    return F.format_string(f"%s_page_%04d_{kind}_%02d.png", stem, page, number)


def fitted_size(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Sides after scaling so that the longer one is ``longest``."""
    most = F.greatest(width, height)
    return (width * ratio(F.lit(float(longest)), most)).cast("long"), (height * ratio(F.lit(float(longest)), most)).cast("long")

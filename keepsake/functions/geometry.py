"""Quads and boxes as Column arithmetic. A quad is an array of (x, y) structs: TL, TR, BR, BL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 1000
MIN_GRID_EXTENT = 5


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, alias: str | None = None, prefix: str = "") -> "Box":
        at = f"{alias}." if alias else ""
        return cls(*[F.col(f"{at}{prefix}{n}") for n in ("x0", "y0", "x1", "y1")])

    def area(self) -> Column:
        return _extent(self.x0, self.x1) * _extent(self.y0, self.y1)

    def overlap(self, other: "Box") -> Column:
        width = _extent(F.greatest(self.x0, other.x0), F.least(self.x1, other.x1))
        height = _extent(F.greatest(self.y0, other.y0), F.least(self.y1, other.y1))
        return width * height

    def meets(self, other: "Box") -> Column:
        return ((self.x0 < other.x1) & (other.x0 < self.x1)
                & (self.y0 < other.y1) & (other.y0 < self.y1))


def _extent(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), (high - low).cast("double"))


def iou(a: Box, b: Box) -> Column:
    shared = a.overlap(b)
    union = a.area() + b.area() - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(0.0)


def containment(inner: Box, outer: Box) -> Column:
    """Share of the inner box that lies inside the outer one."""
    area = inner.area()
    return F.when(area > 0, inner.overlap(outer) / area).otherwise(0.0)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(box: Box) -> Column:
    return F.array(point(box.x0, box.y0), point(box.x1, box.y0),
                   point(box.x1, box.y1), point(box.x0, box.y1))


def corners(quad: Column) -> list[Column]:
    """The four corners one by one, so that all arithmetic on them is compiled."""
    return [F.get(quad, F.lit(i)) for i in range(4)]


def quad_box(quad: Column) -> Box:
    xs, ys = [p.x for p in corners(quad)], [p.y for p in corners(quad)]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def _pick(quad: Column, rank: Callable[[Column], Column], sign: float) -> Column:
    """The corner of smallest signed rank; the earlier one where two tie."""
    keyed = [F.struct((rank(p) * sign).alias("r"), F.lit(i).alias("i"), p.alias("p")) for i, p in enumerate(corners(quad))]
    return F.least(*keyed).p


def order_corners(quad: Column) -> Column:
    total, slant = (lambda p: p.x + p.y), (lambda p: p.y - p.x)
    return F.array(_pick(quad, total, 1.0), _pick(quad, slant, 1.0),
                   _pick(quad, total, -1.0), _pick(quad, slant, -1.0))


def quad_area(quad: Column) -> Column:
    at = corners(quad)
    cross = sum((p.x * q.y - p.y * q.x for p, q in zip(at, [*at[1:], at[0]])), F.lit(0.0))
    return 0.5 * F.abs(cross)


def _each(quad: Column, move: Callable[[Column], Column]) -> Column:
    return F.array(*[move(p) for p in corners(quad)])


def scale_quad(quad: Column, factor: Column) -> Column:
    return _each(quad, lambda p: point(p.x * factor, p.y * factor))


def clip_quad(quad: Column, width: Column, height: Column) -> Column:
    def bound(value: Column, size: Column) -> Column:
        return F.least(F.greatest(value, F.lit(0.0)), F.greatest(F.lit(0.0), (size - 1).cast("double")))

    return _each(quad, lambda p: point(bound(p.x, width), bound(p.y, height)))


def expand_quad(quad: Column, margin: Column) -> Column:
    """Push each corner away from the centre by the margin."""
    at = corners(quad)
    cx, cy = sum((p.x for p in at), F.lit(0.0)) / 4, sum((p.y for p in at), F.lit(0.0)) / 4

    def push(p: Column) -> Column:
        dx, dy = p.x - cx, p.y - cy
        length = F.hypot(dx, dy)
        length = F.when(length == 0, 1.0).otherwise(length)
        return point(p.x + dx / length * margin, p.y + dy / length * margin)

    return _each(quad, push)


def edge_lengths(quad: Column) -> tuple[Column, Column]:
    """(width, height), the longer of each pair of opposite edges."""
    at = corners(quad)

    def between(i: int, j: int) -> Column:
        return F.hypot(at[i].x - at[j].x, at[i].y - at[j].y)

    return F.greatest(between(0, 1), between(3, 2)), F.greatest(between(0, 3), between(1, 2))


def aspect_ratio(quad: Column) -> Column:
    width, height = edge_lengths(quad)
    return F.when((width <= 0) | (height <= 0), F.lit(float("inf"))).otherwise(
        F.greatest(width, height) / F.least(width, height)
    )


def valid_quad(quad: Column) -> Column:
    whole = F.forall(quad, lambda p: p.isNotNull() & p.x.isNotNull() & p.y.isNotNull())
    return F.coalesce((F.size(quad) == 4) & whole, F.lit(False))


def grid_to_pixels(left: Column, top: Column, right: Column, bottom: Column,
                   width: Column, height: Column) -> Column:
    """A 0-1000 grid box in pixels, or null where it is too thin to be an item.

    Clamping happens on the grid, before scaling, so that a box past the edge
    cannot come out inverted.
    """
    def bounded(value: Column) -> Column:
        return F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(float(GRID)))

    x_low, x_high = bounded(F.least(left, right)), bounded(F.greatest(left, right))
    y_low, y_high = bounded(F.least(top, bottom)), bounded(F.greatest(top, bottom))
    given = left.isNotNull() & top.isNotNull() & right.isNotNull() & bottom.isNotNull()
    usable = given & (x_high - x_low >= MIN_GRID_EXTENT) & (y_high - y_low >= MIN_GRID_EXTENT)
    sx, sy = width / GRID, height / GRID
    return F.when(usable, F.struct(
        (x_low * sx).alias("x0"), (y_low * sy).alias("y0"),
        F.least((width - 1).cast("double"), x_high * sx).alias("x1"),
        F.least((height - 1).cast("double"), y_high * sy).alias("y1"),
    ))


def shape_confidence(fill: Column, solidity: Column, fit: Column) -> Column:
    score = (0.55 * F.least(F.lit(1.0), fill) + 0.30 * F.least(F.lit(1.0), solidity)
             + F.when(fit == "poly", 0.15).otherwise(0.05))
    return F.round(F.least(F.lit(1.0), score), 4)


def final_confidence(support: Column, shape: Column) -> Column:
    return F.round(0.70 * support + 0.30 * shape, 4)


def region_confidence(confidence: Column, refined: Column) -> Column:
    return F.round(F.least(F.lit(1.0), confidence * F.when(refined, 1.0).otherwise(0.6)), 4)


def split_confidence(confidence: Column) -> Column:
    return F.least(confidence, F.lit(0.45))


def whole_frame_confidence(confidence: Column, boxes: Column, area_frac: Column,
                           single_frac: float = 0.85) -> Column:
    """A lone box that fills the frame is trusted to at least 0.75."""
    return F.when((boxes == 1) & (area_frac >= single_frac),
                  F.greatest(confidence, F.lit(0.75))).otherwise(confidence)


def rotated(current: Column, delta: Column) -> Column:
    """New rotation, or null where the turn is not a multiple of 90."""
    return F.when(F.pmod(delta, F.lit(90)) == 0, F.pmod(F.coalesce(current, F.lit(0)) + delta, F.lit(360)))

"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets of the pixels around one, by policy.
CARDINAL = ((0, -1), (-1, 0), (1, 0), (0, 1))
CORNERS = ((-1, -1), (1, -1), (-1, 1), (1, 1))
AROUND = CARDINAL + CORNERS


def contrast(a: Column, b: Column) -> Column:
    """How much two intensities differ, in per cent of the larger; 0 if both are 0."""
    return F.coalesce(F.abs(a - b) / F.nullif(F.greatest(a, b), F.lit(0)) * 100.0, F.lit(0.0))


def upper_median(values: Column) -> Column:
    """Of a group: element n/2 of the ascending values, the upper one of an even number."""
    return F.element_at(F.array_sort(F.collect_list(values)), F.floor(F.count(values) / 2).cast("int") + 1)


def lower_median(values: Column) -> Column:
    """Of a group: element n/2 of the descending values, the lower one of an even number."""
    return F.element_at(F.sort_array(F.collect_list(values), asc=False), F.floor(F.count(values) / 2).cast("int") + 1)


def blend(over: Column, under: Column, alpha: Column) -> Column:
    """``over`` mixed into ``under``; both shares are cut to whole numbers before they are added."""
    return (under * (1 - alpha)).cast("int") + (over * alpha).cast("int")


def line_distance(a: Column, b: Column, c: Column, x: Column, y: Column) -> Column:
    """Of a point from ``ax + by + c = 0``."""
    return F.abs(a * x + b * y + c) / F.sqrt(a * a + b * b)


def y_at(a: Column, b: Column, c: Column, x: Column) -> Column:
    """Where a line is at ``x``; null for a vertical one."""
    return F.try_divide(-c - a * x, b)


def x_at(a: Column, b: Column, c: Column, y: Column) -> Column:
    """Where a line is at ``y``; null for a horizontal one."""
    return F.try_divide(-c - b * y, a)


def shifted(a: Column, b: Column, c: Column, dx: Column, dy: Column) -> tuple[Column, Column, Column]:
    """A line given within a box whose corner is at ``dx, dy``, in the frame's own coordinates."""
    return a, b, c - a * dx - b * dy


def central(a: Column, b: Column, c: Column, x: Column, y: Column) -> Column:
    """``struct<x, y>`` of the place on a line beside a centre: below or above it on a line that is rather level, else to its left or right."""
    level = F.abs(b) > F.abs(a)
    return F.struct(F.when(level, x).otherwise(x_at(a, b, c, y)).alias("x"), F.when(level, y_at(a, b, c, x)).otherwise(y).alias("y"))


def crossing(one: tuple[Column, Column, Column], other: tuple[Column, Column, Column]) -> Column:
    """``struct<x, y>`` where two lines meet; null coordinates if they are parallel."""
    (a, b, c), (d, e, f) = one, other
    return F.struct(F.try_divide(b * f - e * c, a * e - d * b).alias("x"), F.try_divide(c * d - f * a, a * e - d * b).alias("y"))


def same_line(one: tuple[Column, Column, Column], other: tuple[Column, Column, Column]) -> Column:
    """Whether all three coefficients agree to eight decimals."""
    same = [F.round(p, 8) == F.round(q, 8) for p, q in zip(one, other, strict=True)]
    return same[0] & same[1] & same[2]


def line_through(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """The coefficients of the line through two points; all zero if they are one."""
    return y1 - y2, x2 - x1, x1 * y2 - x2 * y1


def polar(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """The direction of a line's normal in degrees from 0 to 180 and its signed distance from the origin."""
    norm = F.sqrt(a * a + b * b)
    flip = F.when((b < 0) | ((b == 0) & (a < 0)), -1.0).otherwise(1.0)
    theta = F.degrees(F.atan2(b * flip, a * flip))
    return F.when(theta >= 180, theta - 180).otherwise(theta), F.try_divide(-c * flip, norm)


def polar_points(theta: Column, rho: Column, reach: float = 1000.0) -> tuple[Column, Column, Column, Column]:
    """Two points of a line, ``reach`` to either side of the one nearest to the origin."""
    t = F.radians(theta)
    return rho * F.cos(t) - reach * F.sin(t), rho * F.sin(t) + reach * F.cos(t), rho * F.cos(t) + reach * F.sin(t), rho * F.sin(t) - reach * F.cos(t)


Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The bounds of a row: ``min_x, min_y, max_x, max_y``."""
    return tuple(F.col(prefix + c) for c in ("min_x", "min_y", "max_x", "max_y"))


def box_size(b: Box) -> Column:
    return (b[2] - b[0] + 1) * (b[3] - b[1] + 1)


def box_centre(b: Box) -> tuple[Column, Column]:
    """Half a box's width and height from its corner, not rounded."""
    return b[0] + (b[2] - b[0] + 1) / 2, b[1] + (b[3] - b[1] + 1) / 2


def box_contains(b: Box, x: Column, y: Column) -> Column:
    """Whether a point lies in a box, edges included; never if a coordinate is not a number. Fractions are cut."""
    whole = lambda v: F.when(F.isnan(v.cast("double")) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v).cast("int")
    return F.coalesce(whole(x).between(b[0], b[2]) & whole(y).between(b[1], b[3]), F.lit(False))


def overlap_amount(p: Box, q: Box) -> Column:
    """The area two boxes share, over half of the sum of theirs, cut to a whole number; 0 unless they overlap by more than an edge."""
    strict = (p[0] < q[2]) & (q[0] < p[2]) & (p[1] < q[3]) & (q[1] < p[3])
    shared = (F.least(p[2], q[2]) - F.greatest(p[0], q[0]) + 1) * (F.least(p[3], q[3]) - F.greatest(p[1], q[1]) + 1)
    return F.when(strict, shared / F.floor((box_size(p) + box_size(q)) / 2)).otherwise(0.0)


def centre_theta(p: Box, q: Box) -> Column:
    """The direction of the line between two boxes' centres: 0 if they are level, 90 if one is above the other, between 0 and 90 if they rise
    to the right on a page, between 90 and 180 if they fall."""
    (x1, y1), (x2, y2) = box_centre(p), box_centre(q)
    w, h = F.abs(x1 - x2), F.abs(y1 - y2)
    falls = (x1 < x2) == (y1 < y2)
    return F.when(y1 == y2, 0.0).when(x1 == x2, 90.0).when(falls, 90 + F.degrees(F.atan(h / w))).otherwise(F.degrees(F.atan(w / h)))


def box_crossings(b: Box, line: tuple[Column, Column, Column]) -> Column:
    """``array<struct<x, y>>``: where a line meets the left, right, upper and lower side of a box; a side's lower end isn't part of it."""
    d = [v.cast("double") for v in b]
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    on_x = [F.when((y_at(*line, x) > d[1]) & (y_at(*line, x) <= d[3]), at(x, y_at(*line, x))) for x in (d[0], d[2])]
    on_y = [F.when((x_at(*line, y) > d[0]) & (x_at(*line, y) <= d[2]), at(x_at(*line, y), y)) for y in (d[1], d[3])]
    return F.array_compact(F.array(*on_x, *on_y))


def edge_distance(p: Box, q: Box) -> Column:
    """The distance of two boxes' sides along the line of their centres, of each the last it meets (left, right, upper, lower) no farther from the other's
    centre than the centres are apart, and 3; negative if they reach over each other; the size of the inner one, negative, if one holds the other."""
    holds = lambda a, b: (a[0] <= b[0]) & (a[1] <= b[1]) & (b[2] <= a[2]) & (b[3] <= a[3])
    (x1, y1), (x2, y2) = box_centre(p), box_centre(q)
    line = line_through(x1, y1, x2, y2)
    long = lambda dx, dy: F.sqrt(dx * dx + dy * dy)
    apart = long(x1 - x2, y1 - y2)
    far = lambda s, x, y: long(s["x"] - x, s["y"] - y)
    last = lambda b, x, y: F.try_element_at(F.filter(box_crossings(b, line), lambda s: far(s, x, y).cast("int") <= (apart + 3.0).cast("int")), F.lit(-1))
    mine, theirs = last(p, x2, y2), last(q, x1, y1)
    between = long(mine["x"] - theirs["x"], mine["y"] - theirs["y"])
    both = F.when(far(mine, x1, y1) + far(theirs, x2, y2) < apart, between).otherwise(-between)
    found = F.when(mine.isNotNull() & theirs.isNotNull(), both).when(mine.isNotNull(), far(mine, x2, y2)).when(theirs.isNotNull(), far(theirs, x1, y1)).otherwise(apart)
    return F.when(holds(p, q), -box_size(q).cast("double")).when(holds(q, p), -box_size(p).cast("double")).otherwise(found)


def disc(radius: int) -> list[tuple[int, int, float]]:
    """``dx, dy, distance`` of the places within ``radius``, nearest first, then by row and column: a circle that expands, or, as a set, a mask."""
    return sorted(((dx, dy, math.hypot(dx, dy)) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if math.hypot(dx, dy) <= radius), key=lambda p: (p[2], p[1], p[0]))


def mean_pixel(channels: tuple[str, ...] = ("r", "g", "b")) -> list[Column]:
    """Of a group of pixels the mean of each channel, cut to a whole number."""
    return [F.floor(F.sum(c) / F.count("*")).cast("int").alias(c) for c in channels]


def pixel_difference(one: str = "", other: str = "other_") -> Column:
    """How much a pixel is brighter than another: red, green and a third of blue together, or the largest of the three differences if that is more."""
    r, g, b = (F.col(one + c) - F.col(other + c) for c in ("r", "g", "b"))
    return F.greatest((r + g + b / 3).cast("int"), r, g, b)


def packed(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Four channels of 16 bits in one number, the first in the lowest bits."""
    return r.cast("long").bitwiseOR(F.shiftleft(g.cast("long"), 16)).bitwiseOR(F.shiftleft(b.cast("long"), 32)).bitwiseOR(F.shiftleft(a.cast("long"), 48))


def unpacked(value: Column) -> list[Column]:
    """``r, g, b, a`` of `packed`."""
    return [F.shiftrightunsigned(value, 16 * n).bitwiseAND(F.lit(65535)).cast("int").alias(c) for n, c in enumerate("rgba")]


def offsets(pairs: tuple[tuple[int, int], ...]) -> Column:
    """An array of ``dx, dy`` to explode."""
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in pairs])

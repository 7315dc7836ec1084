"""Layout geometry as column expressions over boxes, arrays [x0, y0, x1, y1] with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def x0(b: Column) -> Column:
    return b[0]


def y0(b: Column) -> Column:
    return b[1]


def x1(b: Column) -> Column:
    return b[2]


def y1(b: Column) -> Column:
    return b[3]


def width(b: Column) -> Column:
    """GEO-01; 0 of a box that is turned around or not one."""
    return F.when(F.size(b) == 4, F.greatest(b[2] - b[0], F.lit(0.0))).otherwise(0.0)


def height(b: Column) -> Column:
    return F.when(F.size(b) == 4, F.greatest(b[3] - b[1], F.lit(0.0))).otherwise(0.0)


def area(b: Column) -> Column:
    return width(b) * height(b)


def intersects(a: Column, b: Column) -> Column:
    """GEO-01; touching edges do not count."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def overlap_x(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))


def overlap_y(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def intersection_area(a: Column, b: Column) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def overlap_ratio(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` inside ``outer``; 0 of an empty box."""
    return F.when(area(inner) > 0, intersection_area(inner, outer) / area(inner)).otherwise(0.0)


def overlap_x_ratio(a: Column, b: Column) -> Column:
    """GEO-02: over the smaller width, 1 at least."""
    return overlap_x(a, b) / F.greatest(F.least(a[2] - a[0], b[2] - b[0]), F.lit(1.0))


def gap_y(upper: Column, lower: Column) -> Column:
    """GEO-02: signed vertical distance."""
    return lower[1] - upper[3]


def expand(b: Column, margin: float, page_width: Column | None = None, page_height: Column | None = None) -> Column:
    """GEO-05: larger by a margin, cut to the page where one is given."""
    right, bottom = b[2] + margin, b[3] + margin
    right = F.least(right, page_width) if page_width is not None else right
    bottom = F.least(bottom, page_height) if page_height is not None else bottom
    left, top = b[0] - margin, b[1] - margin
    if page_width is not None:
        left, top = F.greatest(left, F.lit(0.0)), F.greatest(top, F.lit(0.0))
    return F.array(left, top, right, bottom)


def union(b: Column) -> Column:
    """AGG-17: aggregate of boxes to the box around them."""
    return F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3]))


def union_of(boxes: Column) -> Column:
    """AGG-17 for an array of boxes; null if empty."""
    each = lambda k: F.transform(boxes, lambda b: b[k])
    return F.when(F.size(boxes) > 0, F.array(F.array_min(each(0)), F.array_min(each(1)), F.array_max(each(2)), F.array_max(each(3))))


def multiply(m: Column, n: Column) -> Column:
    """GEO-03: affine matrices (a, b, c, d, e, f), first ``m``, then ``n``."""
    return F.array(
        m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5],
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.array(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])


def transform_box(m: Column, b: Column) -> Column:
    """The upright box around a transformed one."""
    points = [apply(m, b[i], b[j]) for i in (0, 2) for j in (1, 3)]
    return F.array(*(f(*(p[k] for p in points)) for f, k in ((F.least, 0), (F.least, 1), (F.greatest, 0), (F.greatest, 1))))


def flip(b: Column, page_height: Column) -> Column:
    """GEO-03: between an origin at the bottom left and one at the top left."""
    return F.array(b[0], page_height - b[3], b[2], page_height - b[1])


def rotate_in(b: Column, region: Column, degrees: Column) -> Column:
    """GEO-04: a box of a region that is turned by 90 or 270, in upright coordinates of that region."""
    return (
        F.when(degrees == 90, F.array(b[1] - region[1], region[2] - b[2], b[3] - region[1], region[2] - b[0]))
        .when(degrees == 270, F.array(region[3] - b[3], b[0] - region[0], region[3] - b[1], b[2] - region[0]))
        .otherwise(F.array(b[0] - region[0], b[1] - region[1], b[2] - region[0], b[3] - region[1]))
    )


def rotate_back(b: Column, region: Column, degrees: Column) -> Column:
    """GEO-04: the inverse of ``rotate_in``."""
    return (
        F.when(degrees == 90, F.array(region[2] - b[3], region[1] + b[0], region[2] - b[1], region[1] + b[2]))
        .when(degrees == 270, F.array(region[0] + b[1], region[3] - b[2], region[0] + b[3], region[3] - b[0]))
        .otherwise(F.array(b[0] + region[0], b[1] + region[1], b[2] + region[0], b[3] + region[1]))
    )


def direction_to_rotation(dx: Column, dy: Column) -> Column:
    """AGG-12: the writing direction as a multiple of 90 degrees."""
    angle = F.pmod(F.round(F.degrees(F.atan2(dy, dx)) / 90).cast("int") * 90, F.lit(360))
    return F.when((dx == 0) & (dy == 0), 0).otherwise(angle)


def rgb(color: Column) -> Column:
    """GEO-07: a 24-bit colour as three shares."""
    c = F.coalesce(color, F.lit(0)).cast("int")
    return F.array(*(F.shiftright(c, k).bitwiseAND(F.lit(255)) / 255.0 for k in (16, 8, 0)))


FLAGS = {"superscript": 1, "italic": 2, "serif": 4, "monospace": 8, "bold": 16}


def flag(flags: Column, name: str) -> Column:
    """GEO-07: one bit of a span's flags."""
    return F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(FLAGS[name])) > 0


def bucket(value: Column, size: float) -> Column:
    """GEO-10: number of the bucket, halves to even."""
    return F.bround(value / size).cast("int")

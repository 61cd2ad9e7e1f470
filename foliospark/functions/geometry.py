"""Geometry of glyphs, rectangles and images as column expressions.

A glyph's ``dir``, ``ascent`` and ``descent`` may be NULL: upright horizontal
text, with the ascent of its size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def rect(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))


def direction(d: Column) -> Column:
    """Unit vector; (1, 0) where none is given or its length is next to nothing."""
    length = F.hypot(d["x"], d["y"])
    usable = length > 1e-9
    return point(F.when(usable, d["x"] / length).otherwise(1.0), F.when(usable, d["y"] / length).otherwise(0.0))


def baseline(x: Column, y: Column, advance: Column, d: Column) -> Column:
    """(start, end): from the origin along the direction by the advance's amount."""
    u = direction(d)
    length = F.abs(advance)
    return F.struct(point(x, y).alias("start"), point(x + u["x"] * length, y + u["y"] * length).alias("end"))


def quad(x: Column, y: Column, advance: Column, size: Column, d: Column, ascent: Column, descent: Column) -> Column:
    """Four corners: start and end of the baseline, lowered by descent and raised by ascent."""
    ends = baseline(x, y, advance, d)
    zero = F.lit(0.0)
    flat = lambda v: v.isNull() | ((v["x"] == 0) & (v["y"] == 0))
    bare = flat(ascent) & flat(descent)
    ax, ay = F.when(bare, zero).otherwise(F.coalesce(ascent["x"], zero)), F.when(bare, size).otherwise(F.coalesce(ascent["y"], zero))
    dx, dy = F.coalesce(descent["x"], zero), F.coalesce(descent["y"], zero)
    a, b = ends["start"], ends["end"]
    return F.array(point(a["x"] + dx, a["y"] + dy), point(b["x"] + dx, b["y"] + dy), point(b["x"] + ax, b["y"] + ay), point(a["x"] + ax, a["y"] + ay))


def bounds(corners: Column) -> Column:
    """Smallest rectangle around an array of points."""
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def glyph_bounds(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return bounds(quad(c("x"), c("y"), c("advance"), c("size"), c("dir"), c("ascent"), c("descent")))


def intersects(a: Column, b: Column) -> Column:
    """Whether rectangles touch, edges included."""
    return (a["max_x"] >= b["min_x"]) & (b["max_x"] >= a["min_x"]) & (a["max_y"] >= b["min_y"]) & (b["max_y"] >= a["min_y"])


def normalised_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return rect(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def rotation(degrees: Column) -> Column:
    return F.pmod(degrees.cast("int"), F.lit(360))


def projection(x: Column, y: Column, advance: Column, d: Column, end: bool = False) -> Column:
    """Position of a glyph's start or end along a direction."""
    u = direction(d)
    start = x * u["x"] + y * u["y"]
    return start + F.abs(advance) if end else start


def word_gap(size: Column) -> Column:
    """The gap between glyphs that stands for a space."""
    return F.when(size * 0.1 > 0, size * 0.1).otherwise(1.0)


def image_to_page(x: Column, y: Column, width: Column, height: Column, ctm: Column) -> Column:
    """A pixel corner in page space; the first pixel row is the top."""
    u, v = x / width, F.lit(1.0) - y / height
    m = [F.get(ctm, F.lit(i)) for i in range(6)]
    return point(u * m[0] + v * m[2] + m[4], u * m[1] + v * m[3] + m[5])


def image_quad(ctm: Column) -> Column:
    m = [F.get(ctm, F.lit(i)) for i in range(6)]
    return F.array(point(m[4], m[5]), point(m[0] + m[4], m[1] + m[5]), point(m[0] + m[2] + m[4], m[1] + m[3] + m[5]), point(m[2] + m[4], m[3] + m[5]))


def product(m: Column, n: Column) -> Column:
    """Matrix product of two six-number arrays."""
    a = [F.get(m, F.lit(i)) for i in range(6)]
    b = [F.get(n, F.lit(i)) for i in range(6)]
    return F.array(a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def exponential(x: Column, c0: float, c1: float, n: float, low: float = 0.0, high: float = 1.0) -> Column:
    """An exponential interpolation function (type 2) of one input, clipped to its domain."""
    t = F.pow(F.least(F.greatest(x, F.lit(low)), F.lit(high)), F.lit(n))
    return F.lit(c0) + F.when(F.isnan(t), 0.0).otherwise(t) * (c1 - c0)

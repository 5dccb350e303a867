"""Scalar geometry as Column expressions: everything stays inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelyard.config import ANTICLOCKWISE, CLOCKWISE, COLINEAR, GROUND, OBSTACLE

TWO_PI = 2 * math.pi
#: Fixed coefficients of the arctangent's minimax polynomial, highest power first, and the turns of the full circle.
ATAN_COEFFICIENTS = [0.024840285, -0.094097948, 0.18681418, -0.33213072]
HALF_TURN, QUARTER_TURN = 3.14159274, 1.57079637
#: Fixed colours.
RING_COLOURS = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255), (255, 165, 0), (128, 0, 128)]
LABEL_COLOURS = {GROUND: (124, 252, 0), OBSTACLE: (200, 0, 0), 0: (255, 255, 0)}


def num(value: float, kind: str = "double") -> Column:
    return F.lit(value).cast(kind)


def atan2_approx(y: Column, x: Column, kind: str = "double") -> Column:
    """Arctangent of y/x by a polynomial: sums, products and one quotient, so every engine gets the same bits. (0, 0): NaN."""
    ax, ay = F.abs(x), F.abs(y)
    most = F.greatest(ax, ay)
    a = F.when(most == 0, num(math.nan, kind)).otherwise(F.try_divide(F.least(ax, ay), most).cast(kind))
    k = [num(c, kind) for c in ATAN_COEFFICIENTS]
    s = a * a
    q = s * s
    r = ((k[0] * q + k[2]) * s + (k[1] * q + k[3])) * (s * a) + a
    # Folding to the full circle by factors rather than branches keeps r once in the expression.
    for test, turn_ in ((ay > ax, QUARTER_TURN), (x < 0, HALF_TURN)):
        r = F.when(test, num(turn_, kind)).otherwise(num(0.0, kind)) + F.when(test, num(-1.0, kind)).otherwise(num(1.0, kind)) * r
    return F.when(y < 0, num(-1.0, kind)).otherwise(num(1.0, kind)) * r


def planar_range(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def spatial_range(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def azimuth_deg(x: Column, y: Column) -> Column:
    """[0, 360), rounded to 9 places so that bins don't depend on the last bit of the arctangent."""
    a = F.degrees(F.atan2(y, x))
    return F.round(F.when(a < 0, a + 360.0).otherwise(a), 9)


def elevation_deg(x: Column, y: Column, z: Column) -> Column:
    """Angle above the horizon, rounded as ``azimuth_deg``; the origin is at 0."""
    return F.round(F.degrees(F.atan2(z, planar_range(x, y))), 9)


def truncated(x: Column) -> Column:
    """Integer part toward zero."""
    return x.cast("int")


def dist_sq(a: list[Column], b: list[Column]) -> Column:
    out = (a[0] - b[0]) * (a[0] - b[0])
    for p, q in zip(a[1:], b[1:], strict=True):
        out = out + (p - q) * (p - q)
    return out


def cross(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return x1 * y2 - x2 * y1


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle; positive is counter-clockwise."""
    return cross(bx - ax, by - ay, cx - ax, cy - ay)


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    t = turn(ax, ay, bx, by, cx, cy)
    return F.when(t > 0, ANTICLOCKWISE).when(t < 0, CLOCKWISE).otherwise(COLINEAR)


def orientation_eps(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, eps: float = 2.0**-52) -> Column:
    """0 collinear (within eps), 1 clockwise, 2 counter-clockwise."""
    t = (by - ay) * (cx - bx) - (bx - ax) * (cy - by)
    return F.when(F.abs(t) < num(eps), 0).when(t > 0, 1).otherwise(2)


def on_segment(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """Whether q lies in the box of p and r."""
    return qx.between(F.least(px, rx), F.greatest(px, rx)) & qy.between(F.least(py, ry), F.greatest(py, ry))


def segments_intersect(p1: tuple, q1: tuple, p2: tuple, q2: tuple) -> Column:
    """Whether segments p1 q1 and p2 q2 meet; each point is a pair of Columns."""
    o1, o2 = orientation_eps(*p1, *q1, *p2), orientation_eps(*p1, *q1, *q2)
    o3, o4 = orientation_eps(*p2, *q2, *p1), orientation_eps(*p2, *q2, *q1)
    touch = [((o1 == 0), p1, p2, q1), ((o2 == 0), p1, q2, q1), ((o3 == 0), p2, p1, q2), ((o4 == 0), p2, q1, q2)]
    out = (o1 != o2) & (o3 != o4)
    for flat, a, b, c in touch:
        out = out | (flat & on_segment(*a, *b, *c))
    return out


def polygon_area(points: Column) -> Column:
    """Shoelace area of ``array<struct<x, y>>``; under three vertices: 0."""
    n = F.size(points)
    shifted = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    parts = F.zip_with(points, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    area = F.abs(F.aggregate(parts, num(0.0), lambda s, v: s + v)) * 0.5
    return F.when(n > 2, area).otherwise(num(0.0))


def rectangle_area(a: tuple, b: tuple, c: tuple) -> Column:
    return F.sqrt(dist_sq(list(a), list(b)) * dist_sq(list(b), list(c)))


def triangle_area(a: tuple, b: tuple, c: tuple) -> Column:
    return F.abs((a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1])) * 0.5)


def ring_colour(ring: Column) -> Column:
    palette = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", c, strict=True)]) for c in RING_COLOURS])
    return F.element_at(palette, F.pmod(ring, F.lit(len(RING_COLOURS))).cast("int") + 1)


def label_colour(label: Column) -> Column:
    make = lambda c: F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", c, strict=True)])
    return F.when(label == GROUND, make(LABEL_COLOURS[GROUND])).when(label == OBSTACLE, make(LABEL_COLOURS[OBSTACLE])).otherwise(make(LABEL_COLOURS[0]))


def cluster_colour(label: Column) -> Column:
    """A fixed colour for each cluster: three bytes of a multiple of its number, far from its neighbours'."""
    h = F.pmod((label + 1).cast("long") * F.lit(2654435761), F.lit(1 << 32))
    return F.struct(*[F.shiftright(h, s).bitwiseAND(F.lit(255)).cast("int").alias(n) for n, s in (("r", 24), ("g", 16), ("b", 8))])


def stamp_micros(sec: Column, nanosec: Column) -> Column:
    """Timestamp of seconds and nanoseconds."""
    return F.timestamp_micros(sec * 1_000_000 + F.floor(nanosec / 1000))

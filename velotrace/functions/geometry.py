"""Points, rings and lines: arrays of structs (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def sides(points: Column) -> Column:
    """Consecutive pairs of a line's points, as structs a and b."""
    return F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def closed(ring: Column) -> Column:
    """The ring with its first point at its end too."""
    last, first = F.element_at(ring, -1), F.element_at(ring, 1)
    return F.when((last["x"] == first["x"]) & (last["y"] == first["y"]), ring).otherwise(F.concat(ring, F.array(first)))


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    def touches(s: Column) -> Column:
        a, b = s["a"], s["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(sides(closed(ring)), touches)


def in_ring(x: Column, y: Column, ring: Column, border: bool = False) -> Column:
    """SP1: whether a point lies strictly inside a ring, by ray casting; with border, its border counts too.

    Points with a null or non-finite coordinate lie nowhere.
    """

    def crossed(n: Column, s: Column) -> Column:
        a, b = s["a"], s["b"]
        straddles = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return n + F.when(straddles & (x < at), 1).otherwise(0)

    odd = F.aggregate(sides(closed(ring)), F.lit(0), crossed) % 2 == 1
    edge = on_ring(x, y, ring)
    return finite(x) & finite(y) & ((odd | edge) if border else (odd & ~edge))


def length(points: Column) -> Column:
    """SP25: of a line in metres of its own coordinates; 0 for a point, null for null."""
    return F.aggregate(sides(points), F.lit(0.0), lambda n, s: n + F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def line_status(points: Column) -> Column:
    """SP26: invalid_geometry, zero_length or ok."""
    fine = F.forall(points, lambda p: finite(p["x"]) & finite(p["y"]))
    return F.when(points.isNull() | (F.size(points) < 2) | ~F.coalesce(fine, F.lit(False)), "invalid_geometry").when(length(points) <= 0, "zero_length").otherwise("ok")


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """SP27: distance of a point from a segment, and how far along the segment its nearest point lies, in metres."""
    dx, dy = x2 - x1, y2 - y1
    whole = dx * dx + dy * dy
    t = F.least(F.greatest(F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, whole), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy)), t * F.sqrt(whole)


def interpolate(x1: Column, y1: Column, x2: Column, y2: Column, position: Column) -> Column:
    """SP27: the point of a segment at so many metres."""
    t = F.coalesce(F.try_divide(position, F.hypot(x2 - x1, y2 - y1)), F.lit(0.0))
    return F.struct((x1 + t * (x2 - x1)).alias("x"), (y1 + t * (y2 - y1)).alias("y"))


def merge_lines(parts: Column) -> Column:
    """SP28: an ordered array of lines as one; null, empty and zero parts are dropped and joints written once."""
    valid = F.filter(parts, lambda p: p.isNotNull() & (F.size(p) >= 2) & (length(p) > 0))

    def join(acc: Column, p: Column) -> Column:
        last, first = F.try_element_at(acc, F.lit(-1)), F.element_at(p, 1)
        same = F.coalesce((last["x"] == first["x"]) & (last["y"] == first["y"]), F.lit(False))
        return F.concat(acc, F.when(same, F.slice(p, 2, F.size(p))).otherwise(p))

    empty = F.slice(F.element_at(valid, 1), 1, 0)
    return F.when(F.size(valid) > 0, F.aggregate(valid, empty, join))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segments a-b and c-d share a point."""
    side = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    within = lambda p, q, r: r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
    s1, s2, s3, s4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    return ((s1 != s2) & (s3 != s4)) | ((s1 == 0) & within(a, b, c)) | ((s2 == 0) & within(a, b, d)) | ((s3 == 0) & within(c, d, a)) | ((s4 == 0) & within(c, d, b))


def line_meets_ring(points: Column, ring: Column) -> Column:
    """Whether a line has a point in a ring or on its border."""
    crosses = F.exists(sides(points), lambda s: F.exists(sides(closed(ring)), lambda e: segments_cross(s["a"], s["b"], e["a"], e["b"])))
    first = F.element_at(points, 1)
    return F.when(F.size(points) > 0, crosses | in_ring(first["x"], first["y"], ring, True)).otherwise(F.lit(False))

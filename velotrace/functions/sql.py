"""The column functions that are of use in SQL, as temporary functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import DEFAULT
from .hexgrid import SQRT3, circumradius
from .projection import sql_forward

_HAV = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
_X, _Y = sql_forward("lon", "lat")
#: Sides of a ring, its last point joined to its first, as structs a and b.
_SIDES = "zip_with(ring, concat(slice(ring, 2, greatest(size(ring) - 1, 0)), slice(ring, 1, 1)), (a, b) -> struct(a, b))"
_ON = "(s.b.x - s.a.x) * (py - s.a.y) = (s.b.y - s.a.y) * (px - s.a.x) AND px BETWEEN least(s.a.x, s.b.x) AND greatest(s.a.x, s.b.x) AND py BETWEEN least(s.a.y, s.b.y) AND greatest(s.a.y, s.b.y)"
_CROSSED = "(s.a.y > py) != (s.b.y > py) AND px < s.a.x + try_divide((py - s.a.y) * (s.b.x - s.a.x), s.b.y - s.a.y)"


def _hexagon(size: float) -> str:
    c = circumradius(size)
    frac = f"struct((x * {SQRT3 / 3!r}D - y / 3) / {c!r}D AS q, (y * {2.0 / 3!r}D) / {c!r}D AS r)"
    near = "struct(rint(f.q) AS q, rint(f.r) AS r, rint(-f.q - f.r) AS s, abs(rint(f.q) - f.q) AS dq, abs(rint(f.r) - f.r) AS dr, abs(rint(-f.q - f.r) + f.q + f.r) AS ds)"
    fix = "n.dq > n.ds AND n.dq > n.dr"
    whole = f"struct(CAST(if({fix}, -n.s - n.r, n.q) AS BIGINT) AS q, CAST(if({fix} OR n.ds > n.dr, n.r, -n.q - n.s) AS BIGINT) AS r)"
    return f"element_at(transform(transform(array({frac}), f -> {near}), n -> {whole}), 1)"


def register(spark: SparkSession, hex_size_m: float = DEFAULT.hex_size_m) -> list[str]:
    """haversine_m(lat1, lon1, lat2, lon2), utm50n(lon, lat), hex_bin(x, y) and point_in_ring(x, y, ring), which follow the
    column functions of those names; the names that are there afterwards."""
    bodies = {
        "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": f"{2 * DEFAULT.earth_radius_m!r}D * asin(sqrt(least(greatest({_HAV}, 0.0D), 1.0D)))",
        "utm50n(lon DOUBLE, lat DOUBLE) RETURNS STRUCT<x: DOUBLE, y: DOUBLE>": f"struct({_X} AS x, {_Y} AS y)",
        "hex_bin(x DOUBLE, y DOUBLE) RETURNS STRUCT<q: BIGINT, r: BIGINT>": _hexagon(hex_size_m),
        "point_in_ring(px DOUBLE, py DOUBLE, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>) RETURNS BOOLEAN": f"size(filter({_SIDES}, s -> {_CROSSED})) % 2 = 1 AND NOT exists({_SIDES}, s -> {_ON})",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in bodies]

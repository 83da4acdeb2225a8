"""Pointy-top hexagons in axial coordinates."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

#: Axial steps to the six neighbours. Fixed values.
NEIGHBOURS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
SQRT3 = math.sqrt(3.0)


def circumradius(size: float) -> float:
    """SP4: of a hexagon whose area is size squared."""
    return math.sqrt(size * size / (1.5 * SQRT3))


def with_axial(df: DataFrame, size: float, x: str = "x", y: str = "y", q: str = "q", r: str = "r") -> DataFrame:
    """SP5 and SP6: df with the hexagon of a point; ties as the cube rounding has them.

    On an edge of hexagons the last bit decides. Decimal coordinates are therefore multiplied as decimals, the product
    being rounded once, when it becomes a double, and summed in the order of their SQL (SP5); doubles in that of theirs.
    """
    c = circumradius(size)
    exact = isinstance(df.schema[x].dataType, DecimalType)

    def times(name: str, k: float) -> Column:
        return (F.col(name) * F.lit(Decimal(repr(k)))).cast("double") if exact else F.col(name) * k

    d = df.withColumns({"_qf": (times(x, SQRT3 / 3) - F.col(y).cast("double") / 3) / c, "_rf": times(y, 2.0 / 3) / c})
    qf, rf = F.col("_qf"), F.col("_rf")
    d = d.withColumns({"_q": F.rint(qf), "_r": F.rint(rf), "_s": F.rint(-qf - rf)})
    d = d.withColumns({"_dq": F.abs(F.col("_q") - qf), "_dr": F.abs(F.col("_r") - rf), "_ds": F.abs(F.col("_s") + qf + rf if exact else F.col("_s") - (-qf - rf))})
    fix_q = (F.col("_dq") > F.col("_ds")) & (F.col("_dq") > F.col("_dr"))
    fixed = {
        q: F.when(fix_q, -F.col("_s") - F.col("_r")).otherwise(F.col("_q")).cast("long"),
        r: F.when(fix_q | (F.col("_ds") > F.col("_dr")), F.col("_r")).otherwise(-F.col("_q") - F.col("_s")).cast("long"),
    }
    return d.withColumns(fixed).drop("_qf", "_rf", "_q", "_r", "_s", "_dq", "_dr", "_ds")


def centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    """SP7: metres of the middle of a hexagon."""
    r_ = circumradius(size)
    return (q * SQRT3 + r * (SQRT3 / 2)) * r_, r * (1.5 * r_)


def corners(q: Column, r: Column, size: float) -> Column:
    """SP7: the six corners as an array of (x, y)."""
    x, y = centre(q, r, size)
    r_ = circumradius(size)
    angle = lambda k: math.radians(30 + 60 * k)
    return F.array(*[F.struct((x + r_ * math.cos(angle(k))).alias("x"), (y + r_ * math.sin(angle(k))).alias("y")) for k in range(6)])


def neighbours(q: Column, r: Column, itself: bool = False) -> Column:
    """SP8: the neighbours as an array of (q, r)."""
    steps = ((0, 0), *NEIGHBOURS) if itself else NEIGHBOURS
    return F.array(*[F.struct((q + a).alias("q"), (r + b).alias("r")) for a, b in steps])

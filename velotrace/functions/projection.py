"""UTM zone 50 north (EPSG:32650) as column expressions, by the Krueger series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, FLAT, K0, LON0, X0 = 6378137.0, 1 / 298.257223563, 0.9996, 117.0, 500000.0
N = FLAT / (2 - FLAT)
E = math.sqrt(FLAT * (2 - FLAT))
R = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)


def with_utm(df: DataFrame, lon: str = "longitude", lat: str = "latitude", x: str = "x", y: str = "y") -> DataFrame:
    """df with metres east and north of degrees. Each step is a column of its own, so no expression is repeated."""
    lam = F.radians(F.col(lon) - LON0)
    d = df.withColumn("_s", F.sin(F.radians(F.col(lat)))).withColumn("_t", F.sinh(F.atanh("_s") - E * F.atanh(E * F.col("_s"))))
    d = d.withColumns({"_xi": F.atan2("_t", F.cos(lam)), "_eta": F.asinh(F.sin(lam) / F.sqrt(F.col("_t") * F.col("_t") + F.cos(lam) * F.cos(lam)))})
    xi, eta = F.col("_xi"), F.col("_eta")
    north = xi + sum((F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
    east = eta + sum((F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
    return d.withColumns({x: F.lit(X0) + F.lit(K0 * R) * east, y: F.lit(K0 * R) * north}).drop("_s", "_t", "_xi", "_eta")


def inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of metres east and north; three Newton steps reach double precision."""
    xi, eta = y / (K0 * R), (x - X0) / (K0 * R)
    xi_ = xi - sum((F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    eta_ = eta - sum((F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    target = F.sin(xi_) / F.sqrt(F.sinh(eta_) * F.sinh(eta_) + F.cos(xi_) * F.cos(xi_))
    start = F.struct(target.alias("t"), target.alias("goal"))

    def newton(acc: Column, _: Column) -> Column:
        t = acc["t"]
        sigma = F.sinh(E * F.atanh(E * t / F.sqrt(1 + t * t)))
        back = t * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + t * t)
        step = (acc["goal"] - back) / F.sqrt(1 + back * back) * (1 + (1 - E * E) * t * t) / ((1 - E * E) * F.sqrt(1 + t * t))
        return F.struct((t + step).alias("t"), acc["goal"].alias("goal"))

    t = F.aggregate(F.array(*map(F.lit, range(4))), start, newton, lambda acc: acc["t"])
    return F.lit(LON0) + F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_))), F.degrees(F.atan(t))


def sql_forward(lon: str, lat: str) -> tuple[str, str]:
    """The same as SQL text, for engines that lack this library."""
    phi, lam = f"radians({lat})", f"radians({lon} - {LON0!r})"
    t = f"sinh(atanh(sin({phi})) - {E!r} * atanh({E!r} * sin({phi})))"
    xi, eta = f"atan2({t}, cos({lam}))", f"asinh(sin({lam}) / sqrt({t} * {t} + cos({lam}) * cos({lam})))"
    east = " + ".join([eta, *(f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(ALPHA, 1))])
    north = " + ".join([xi, *(f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(ALPHA, 1))])
    return f"({X0!r} + {K0 * R!r} * ({east}))", f"({K0 * R!r} * ({north}))"

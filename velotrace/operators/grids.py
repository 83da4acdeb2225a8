"""Hexagon and raster aggregation, density, persistence and space-time statistics.

Rasters are long tables of (row, col, value), rows counted from the north.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import hexgrid
from ..functions.geometry import finite
from ..functions.scalars import congestion_level, hour_of_day
from .graphs import cut_lineage
from .trajectory import with_hexagon

FASTEST_SANE_KMH = 200.0


@dataclass(frozen=True)
class Grid:
    """SP13: a raster's place: metres, square cells."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    cell: float
    crs: str = "EPSG:32650"

    @classmethod
    def around(cls, xmin: float, ymin: float, xmax: float, ymax: float, cell: float) -> Grid:
        """Snapped outward to whole cells."""
        return cls(math.floor(xmin / cell) * cell, math.floor(ymin / cell) * cell, math.ceil(xmax / cell) * cell, math.ceil(ymax / cell) * cell, cell)

    @property
    def width(self) -> int:
        return round((self.xmax - self.xmin) / self.cell)

    @property
    def height(self) -> int:
        return round((self.ymax - self.ymin) / self.cell)


def hex_stats(df: DataFrame, c: Settings = DEFAULT, extra: list[str] | None = None) -> DataFrame:
    """A1: per hexagon; means leave out drifted rows, and speeds beyond 200 km/h."""
    fine = F.col("is_outlier_drift") == 0
    return with_hexagon(df, c.hex_size_m, "grid_q", "grid_r").groupBy(*(extra or []), "grid_q", "grid_r").agg(
        F.count(F.lit(1)).alias("point_count"),
        F.avg(F.when(fine & (F.col("speed_gps_kmh") <= FASTEST_SANE_KMH), F.col("speed_gps_kmh"))).alias("mean_speed_gps_kmh"),
        F.avg(F.when(fine, F.col("heading_delta_deg"))).alias("mean_heading_delta_deg"),
        F.count_if(F.col("event_type") == "pickup").alias("pickup_count"),
        F.count_if(F.col("event_type") == "dropoff").alias("dropoff_count"),
    )


def hex_hours(df: DataFrame, speed: str, congested: Column, c: Settings = DEFAULT) -> DataFrame:
    """A2: per hexagon and local hour, without rows at breaks and bad coordinates."""
    d = with_hexagon(df.where("trip_break = 0 and bad_coord = 0"), c.hex_size_m, "grid_q", "grid_r")
    d = d.groupBy("grid_q", "grid_r", hour_of_day(F.col("timestamp")).alias("hour"))
    d = d.agg(F.count(F.lit(1)).alias("point_count"), F.count_if(congested).alias("congested_point_count"), F.avg(speed).alias("mean_speed_kmh"))
    return d.withColumn("congestion_level", congestion_level(F.col("mean_speed_kmh")))


def histogram(points: DataFrame, grid: Grid, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """A3: counts, or sums of a weight, of points (x, y) in cells; points beyond the grid are left out."""
    # what is no number, or far off, lies in a cell beyond the grid
    place = lambda v: F.floor(F.greatest(F.least(v / grid.cell, F.lit(1e9)), F.lit(-1e9))).cast("long")
    col, row = place(F.col("x") - grid.xmin), F.lit(grid.height - 1) - place(F.col("y") - grid.ymin)
    fine = finite(F.col(weight).cast("double")) if weight else F.lit(True)  # a weight that is no number takes no part
    value = F.sum(F.when(fine, F.col(weight))) if weight else F.count(F.lit(1)).cast("double")
    d = points.groupBy(*(by or []), row.alias("row"), col.alias("col")).agg(value.alias("value"), F.count_if(fine).alias("_n"))
    # cells are left out after they are counted, by a condition that can't be moved below, where x and y would be worked out
    # again for each of its uses
    inside = F.when(F.col("_n") > 0, F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    return d.where(inside).drop("_n")


def kernel(radius: float, cell: float, script: bool = False) -> list[tuple[int, int, float]]:
    """SP10 and SP11: offsets and weights of the quartic kernel; the script's radius is in whole cells."""
    r = max(1, round(radius / cell)) if script else radius / cell
    half = max(1, round(radius / cell)) if script else max(1, math.ceil(radius / cell))
    out = []
    for i in range(-half, half + 1):
        for j in range(-half, half + 1):
            d = math.hypot(i, j)
            if d < r:
                out.append((i, j, (1 - (d / r) ** 2) ** 2 * 3 / (math.pi * r * r)))
    return out


def density(cells: DataFrame, grid: Grid, radius: float, by: list[str] | None = None, script: bool = False) -> DataFrame:
    """SP12: points a square kilometre: each cell spreads over the kernel's offsets, a table of constants; values under
    a millionth of the highest are dropped."""
    by = by or []
    cells = cut_lineage(cells)  # as many as the grid has at most, and read twice
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in kernel(radius, grid.cell, script)])
    spread = cells.select(*by, "row", "col", "value", F.explode(offsets).alias("o"))
    row, col = F.col("row") + F.col("o.i"), F.col("col") + F.col("o.j")
    spread = spread.select(*by, row.alias("row"), col.alias("col"), (F.col("value") * F.col("o.w")).alias("value"))
    d = spread.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)).groupBy(*by, "row", "col").agg(F.sum("value").alias("value"))
    top = d.groupBy(*by).agg(F.max("value").alias("_top")) if by else d.agg(F.max("value").alias("_top"))
    d = d.join(top, by) if by else d.crossJoin(F.broadcast(top))
    return d.where(F.col("value") >= F.col("_top") * 1e-6).select(*by, "row", "col", (F.col("value") * (1000.0 / grid.cell) ** 2).alias("value"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SP15: a less b, a cell that is missing being 0."""
    d = a.select("row", "col", F.col("value").alias("a")).join(b.select("row", "col", F.col("value").alias("b")), ["row", "col"], "full")
    return d.select("row", "col", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("value"))


def stack(bands: dict[str, DataFrame]) -> DataFrame:
    """SP16: (band_idx, label, row, col, value) in the order given."""
    parts = [d.select(F.lit(i).alias("band_idx"), F.lit(label).alias("label"), "row", "col", "value") for i, (label, d) in enumerate(bands.items(), 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def daily_hotspots(cells: DataFrame, top: float = DEFAULT.hotspot_top_fraction, by: str = "label") -> DataFrame:
    """Cells with their day's threshold, the exact percentile of its positive cells, and hot = 0 or 1."""
    positive = cells.where("value > 0")
    limit = positive.groupBy(by).agg(F.percentile("value", F.lit(1 - top)).alias("threshold"), F.max("value").alias("highest"))
    return positive.join(limit, by).withColumn("hot", (F.col("value") >= F.col("threshold")).cast("int"))


def persistence(hot: DataFrame, days: int, script: bool = False, by: str = "label") -> DataFrame:
    """A5 and SP17: on how many days a cell was hot, and its mean density over the threshold (script: the highest)."""
    norm = F.col("value") / F.col("highest" if script else "threshold")
    return hot.groupBy("row", "col").agg(F.sum("hot").cast("int").alias("persistence"), (F.sum(norm) / days).alias("mean_norm"))


def regions(cells: DataFrame, labels: DataFrame, grid: Grid, least: int = DEFAULT.component_min_cells) -> DataFrame:
    """A7, SP20, SP21, O5: components of a size with their area, means, middle, cells and rank by density, then area."""
    x = F.lit(grid.xmin) + (F.col("col") + 0.5) * grid.cell
    y = F.lit(grid.ymax) - (F.col("row") + 0.5) * grid.cell
    d = cells.join(labels, ["row", "col"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("persistence").alias("mean_persistence"),
        F.avg("mean_norm").alias("mean_density_norm"),
        F.avg(x).alias("center_x"),
        F.avg(y).alias("center_y"),
        F.array_sort(F.collect_list(F.struct("row", "col"))).alias("cells"),
    )
    d = d.where(F.col("n_cells") >= least).withColumn("area_km2", F.col("n_cells") * grid.cell**2 / 1e6)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_density_norm"), F.desc("area_km2"), "label")))


def multipolygon(cells: Column, grid: Grid) -> Column:
    """SP20: cells (row, col) as a WKT MULTIPOLYGON of their squares, in the order of the array."""

    def square(c: Column) -> Column:
        x = [F.lit(grid.xmin) + (c["col"] + i) * F.lit(float(grid.cell)) for i in (0, 1)]
        y = [F.lit(grid.ymax) - (c["row"] + i) * F.lit(float(grid.cell)) for i in (1, 0)]
        corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        return F.concat(F.lit("(("), F.concat_ws(", ", *[F.concat_ws(" ", x[i].cast("string"), y[j].cast("string")) for i, j in corners]), F.lit("))"))

    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(cells, square), ", "), F.lit(")"))


def align_days(stats: DataFrame, value: str, day: str = "label") -> DataFrame:
    """Every cell on every day, 0 where it had none."""
    stats = cut_lineage(stats)  # small, and read several times
    cells, days = stats.select("q", "r").distinct(), stats.select(day).distinct()
    # days are a handful; each cell is repeated once for each
    every = cells.crossJoin(F.broadcast(days))
    return every.join(stats.select("q", "r", day, value), ["q", "r", day], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def gi_star(aligned: DataFrame, value: str, day: str = "label") -> DataFrame:
    """SP22 and J13: Getis-Ord Gi* with each cell and its neighbours, all of weight one."""
    aligned = cut_lineage(aligned)
    whole = aligned.groupBy(day).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    near = aligned.select(day, F.col(value).alias("_v"), F.explode(hexgrid.neighbours(F.col("q"), F.col("r"), True)).alias("_c"))
    local = near.groupBy(day, F.col("_c.q").alias("q"), F.col("_c.r").alias("r")).agg(F.sum("_v").alias("_sum"), F.count(F.lit(1)).alias("_w"))
    d = aligned.join(local, [day, "q", "r"]).join(whole, day)
    under = F.col("_sd") * F.sqrt(F.try_divide(F.col("_n") * F.col("_w") - F.col("_w") * F.col("_w"), F.col("_n") - 1))
    z = F.when((F.col("_sd") > 0) & (under > 0), (F.col("_sum") - F.col("_mean") * F.col("_w")) / under).otherwise(0.0)
    return d.select("q", "r", day, value, z.alias("gi_star"))


def mann_kendall(values: Column) -> Column:
    """SP23: Z of an array of values in order of time, without a correction for ties."""
    n = F.size(values)
    later = lambda i, x: F.aggregate(F.slice(values, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0.0), lambda a, y: a + F.signum(y - x))
    s = F.aggregate(F.transform(values, lambda x, i: later(i, x)), F.lit(0.0), lambda a, b: a + b)
    var = n * (n - 1) * (2 * n + 5) / 18.0
    return F.when(var <= 0, 0.0).when(s > 0, (s - 1) / F.sqrt(var)).when(s < 0, (s + 1) / F.sqrt(var)).otherwise(0.0)


def pattern(gi: Column, mk: Column, alpha: float = DEFAULT.alpha_z) -> Column:
    """SP24: the class of a cell by its days' Gi* and its trend."""
    hot, cold, n = F.size(F.filter(gi, lambda z: z > alpha)), F.size(F.filter(gi, lambda z: z < -alpha)), F.size(gi)
    first = F.struct(F.lit(0).alias("run"), F.lit(True).alias("on"))
    trailing = F.aggregate(F.reverse(gi), first, lambda a, z: F.struct((a["run"] + F.when(a["on"] & (z > alpha), 1).otherwise(0)).alias("run"), (a["on"] & (z > alpha)).alias("on")), lambda a: a["run"])
    return (
        F.when((hot == 0) & (cold == 0), "no_pattern_detected")
        .when((hot > 0) & (cold > 0), "oscillating_hotspot")
        .when((hot == n) & (mk > alpha), "intensifying_hotspot")
        .when((hot == n) & (mk < -alpha), "diminishing_hotspot")
        .when(hot == n, "persistent_hotspot")
        .when(cold == n, "persistent_coldspot")
        .when((hot > 0) & (trailing == hot) & (trailing >= 2), "consecutive_hotspot")
        .when(hot > 0, "sporadic_hotspot")
        .otherwise("sporadic_coldspot")
    )


def space_time_clusters(stats: DataFrame, value: str, alpha: float = DEFAULT.alpha_z, day: str = "label") -> DataFrame:
    """SP22 to SP24 over days: (q, r, mk_trend_z, category, values, gi) with the days in order."""
    z = gi_star(align_days(stats, value, day), value, day)
    g = z.groupBy("q", "r").agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).alias("v"), F.col("gi_star").alias("z")))).alias("_s"))
    g = g.select("q", "r", F.transform("_s", lambda s: s["v"]).alias("day_values"), F.transform("_s", lambda s: s["z"]).alias("gi"))
    return g.withColumn("mk_trend_z", mann_kendall(F.col("day_values"))).withColumn("category", pattern(F.col("gi"), F.col("mk_trend_z"), alpha))


def fishnet_lengths(segments: DataFrame, cell: float, by: list[str]) -> DataFrame:
    """J14 and SP29: metres of segments (x1, y1, x2, y2) in each cell, by other columns too.

    A segment is cut at the grid lines it crosses: the sorted parameters of all crossings bound its pieces.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))

    def cuts(a: Column, b: Column) -> Column:
        low, high = F.least(a, b), F.greatest(a, b)
        first, last = F.floor(low / cell).cast("long") + 1, F.ceil(high / cell).cast("long") - 1
        lines = F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda k: (k * F.lit(float(cell)) - a) / (b - a))

    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts(x1, x2), cuts(y1, y2))))
    d = segments.withColumn("_t", t)
    pairs = F.zip_with(F.slice("_t", 1, F.size("_t") - 1), F.slice("_t", 2, F.size("_t") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    d = d.withColumn("_p", F.explode(pairs))
    mid = (F.col("_p.a") + F.col("_p.b")) / 2
    col, row = F.floor((x1 + mid * (x2 - x1)) / cell), F.floor((y1 + mid * (y2 - y1)) / cell)
    metres = F.hypot(x2 - x1, y2 - y1) * (F.col("_p.b") - F.col("_p.a"))
    return d.groupBy(*by, row.cast("long").alias("row"), col.cast("long").alias("col")).agg(F.sum(metres).alias("metres"))


def zero_filled(cube: DataFrame, cell: list[str], step: str, value: str, first: int, last: int, width: int) -> DataFrame:
    """SP29: every cell at every step from first to last."""
    every = cube.select(*cell).distinct().withColumn(step, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), F.lit(width).cast("long"))))
    return every.join(cube, [*cell, step], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def preview(cells: DataFrame, floor: float = 0.25) -> DataFrame:
    """What a picture would show: cells above the percentile of positive ones, stretched by log1p."""
    positive = cells.where("value > 0")
    limit = positive.agg(F.percentile("value", F.lit(floor)).alias("_low"))
    return positive.crossJoin(F.broadcast(limit)).where(F.col("value") >= F.col("_low")).select("row", "col", F.log1p("value").alias("shade"))

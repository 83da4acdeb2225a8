"""Queries of hexagon, raster and space-time operators, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import geometry, hexgrid, projection
from ..functions.scalars import density_window
from ..operators import graphs, grids
from ..operators import trajectory as T
from ..operators.polygons import first_area, flagged, with_area
from .registry import query
from .trajectory import CONGESTED, CTE, HEXED, POINTS, featured, gated_points, labelled, pings, table

#: The pings lie in a box of two kilometres; cells are small so that it holds many.
GRID = grids.Grid.around(447600.0, 4415700.0, 449900.0, 4418100.0, 150.0)
RADIUS = 400.0
WEEK = Settings(hotspot_top_fraction=0.2)
X, Y = projection.sql_forward("longitude", "latitude")
XY = f"{CTE}, xy AS (SELECT *, {X} AS x, {Y} AS y FROM features)"
CELL = f"{GRID.height - 1} - CAST(floor((y - {GRID.ymin}) / {GRID.cell}) AS BIGINT) AS row, CAST(floor((x - {GRID.xmin}) / {GRID.cell}) AS BIGINT) AS col"
INSIDE = f"x >= {GRID.xmin} AND x < {GRID.xmax} AND y >= {GRID.ymin} AND y < {GRID.ymax}"
KERNEL = "kernel(i, j, w) AS (VALUES " + ", ".join(f"({i}, {j}, CAST({w!r} AS DOUBLE))" for i, j, w in grids.kernel(RADIUS, GRID.cell)) + ")"


def kde_sql(where: str, weight: str = "1.0", by: str = "") -> str:
    b = f"{by}, " if by else ""
    top = f"max(v) OVER (PARTITION BY {by})" if by else "max(v) OVER ()"
    return f"""{XY}, {KERNEL},
hist AS (SELECT {b}{CELL}, CAST(sum({weight}) AS DOUBLE) AS value FROM xy WHERE {INSIDE} AND {where} GROUP BY ALL),
spread AS (SELECT {b}row + i AS row, col + j AS col, sum(value * w) AS v FROM hist, kernel WHERE row + i BETWEEN 0 AND {GRID.height - 1} AND col + j BETWEEN 0 AND {GRID.width - 1} GROUP BY ALL),
kept AS (SELECT *, {top} AS top FROM spread),
kde AS (SELECT {b}row, col, v * {(1000.0 / GRID.cell) ** 2!r} AS value FROM kept WHERE v >= top * 1e-6)"""


def projected(spark, sf_dir) -> DataFrame:
    return projection.with_utm(featured(spark, sf_dir)).withColumn("label", (F.col("day") % 7).cast("int"))


def kde(d: DataFrame, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    out = grids.density(grids.histogram(d, GRID, weight, by), GRID, RADIUS, by)
    return out.select(*(by or []), "row", "col", F.round("value", 6).alias("value"))


@query("SP3_projection", f"{XY} SELECT src_seq, round(x, 4) AS x, round(y, 4) AS y FROM xy")
def project(spark, sf_dir):
    return projected(spark, sf_dir).select("src_seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SP3_round_trip", f"{CTE} SELECT src_seq, round(longitude, 9) AS lon, round(latitude, 9) AS lat FROM features")
def round_trip(spark, sf_dir):
    lon, lat = projection.inverse(F.col("x"), F.col("y"))
    return projected(spark, sf_dir).select("src_seq", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("SP6_hex_bins", f"{CTE}, {HEXED} SELECT src_seq, q, r FROM hexed")
def hex_bins(spark, sf_dir):
    return T.with_hexagon(featured(spark, sf_dir), DEFAULT.hex_size_m).select("src_seq", "q", "r")


@query(
    "SP7_hex_corners",
    f"{CTE}, {HEXED}, c AS (SELECT DISTINCT q, r FROM hexed), k AS (SELECT unnest(range(0, 6)) AS k) "
    f"SELECT q, r, k, round({hexgrid.circumradius(300.0)!r} * (q * {hexgrid.SQRT3!r} + r * {hexgrid.SQRT3 / 2!r}) + {hexgrid.circumradius(300.0)!r} * cos(radians(30 + 60 * k)), 4) AS x, "
    f"round(r * {1.5 * hexgrid.circumradius(300.0)!r} + {hexgrid.circumradius(300.0)!r} * sin(radians(30 + 60 * k)), 4) AS y FROM c, k",
)
def hex_corners(spark, sf_dir):
    d = hex_bins(spark, sf_dir).select("q", "r").distinct()
    d = d.select("q", "r", F.posexplode(hexgrid.corners(F.col("q"), F.col("r"), 300.0)).alias("k", "p"))
    return d.select("q", "r", F.col("k").cast("long").alias("k"), F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query(
    "A1_hex_stats",
    f"""{CTE}, {HEXED}
SELECT q AS grid_q, r AS grid_r, count(*) AS point_count, round(avg(CASE WHEN is_outlier_drift = 0 AND speed_gps_kmh <= 200 THEN speed_gps_kmh END), 6) AS mean_speed_gps_kmh,
  round(avg(CASE WHEN is_outlier_drift = 0 THEN heading_delta_deg END), 6) AS mean_heading_delta_deg, count(*) FILTER (event_type = 'pickup') AS pickup_count, count(*) FILTER (event_type = 'dropoff') AS dropoff_count
FROM hexed GROUP BY ALL""",
)
def hex_stats(spark, sf_dir):
    d = grids.hex_stats(featured(spark, sf_dir))
    return d.withColumns({c: F.round(c, 6) for c in ("mean_speed_gps_kmh", "mean_heading_delta_deg")})


@query(
    "A2_hex_hours",
    f"""{CONGESTED}, {HEXED.replace('FROM features', 'FROM labelled')}
SELECT q AS grid_q, r AS grid_r, CAST((timestamp + 28800) % 86400 // 3600 AS INTEGER) AS hour, count(*) AS point_count, count(*) FILTER (congestion = 1) AS congested_point_count, round(avg(speed_reported_kmh), 9) AS mean_speed_kmh,
  CASE WHEN avg(speed_reported_kmh) > 30 THEN '畅通' WHEN avg(speed_reported_kmh) > 20 THEN '轻度拥挤' WHEN avg(speed_reported_kmh) > 10 THEN '拥挤' ELSE '严重拥挤' END AS congestion_level
FROM hexed WHERE trip_break = 0 AND bad_coord = 0 GROUP BY ALL""",
)
def hex_hours(spark, sf_dir):
    d = grids.hex_hours(labelled(spark, sf_dir), "speed_reported_kmh", F.col("congestion") == 1)
    return d.withColumn("mean_speed_kmh", F.round("mean_speed_kmh", 9))


@query("A3_histogram", f"{XY} SELECT {CELL}, CAST(count(*) AS DOUBLE) AS value FROM xy WHERE {INSIDE} GROUP BY ALL")
def histogram(spark, sf_dir):
    return grids.histogram(projected(spark, sf_dir), GRID)


THEMES = {
    "baseline": "true",
    "occupied": "occupied = 1",
    "empty": "occupied = 0",
    "low_speed": "trip_break = 0 AND dt_sec >= 8 AND speed_gps_kmh < 10",
    "turns": "trip_break = 0 AND dt_sec >= 8 AND speed_gps_kmh >= 5 AND heading_delta_deg >= 45",
    "pickup": "event_type = 'pickup'",
    "dropoff": "event_type = 'dropoff'",
}


def _theme(name: str, where: str) -> None:
    weight = "heading_delta_deg" if name == "turns" else None

    @query(f"SP14_density_{name}", kde_sql(where, weight or "1.0") + " SELECT row, col, round(value, 6) AS value FROM kde")
    def density(spark, sf_dir):
        return kde(projected(spark, sf_dir).where(where), weight)


for _name, _where in THEMES.items():
    _theme(_name, _where)


#: SP14's windows of the local day (fixed values), and by how many hours pings, which are of a morning, are moved there.
WINDOWS = {"morning": (7, 9, 0), "off_peak": (9, 17, 0), "evening": (17, 19, 10), "night": (0, 6, 18)}


def _window(name: str, begin: int, end: int, later: int) -> None:
    hour = f"((timestamp + {28800 + later * 3600}) % 86400 // 3600)"

    @query(f"SP14_density_{name}", kde_sql(f"{hour} >= {begin} AND {hour} < {end}") + " SELECT row, col, round(value, 6) AS value FROM kde")
    def density(spark, sf_dir):
        return kde(projected(spark, sf_dir).where(density_window(F.col("timestamp") + later * 3600) == name))


for _name, _parts in WINDOWS.items():
    _window(_name, *_parts)


def other_kde(where: str, name: str) -> str:
    """kde_sql's steps under other names, to stand beside them."""
    steps = kde_sql(where).split("hist AS (", 1)[1]
    for step in ("hist", "spread", "kept", "kde"):
        steps = re.sub(rf"\b{step}\b", f"{step}_{name}", steps)
    return f"hist_{name} AS ({steps}"


@query(
    "SP15_density_difference",
    f"""{kde_sql('occupied = 1')}, {other_kde('occupied = 0', 'empty')}
SELECT row, col, round(coalesce(kde.value, 0) - coalesce(kde_empty.value, 0), 6) AS value FROM kde FULL JOIN kde_empty USING (row, col)""",
)
def density_difference(spark, sf_dir):
    d = projected(spark, sf_dir)
    of = lambda where: grids.density(grids.histogram(d.where(where), GRID), GRID, RADIUS)
    return grids.difference(of("occupied = 1"), of("occupied = 0")).withColumn("value", F.round("value", 6))


DAILY = kde_sql("true", "1.0", "day % 7").replace("day % 7, ", "CAST(day % 7 AS INTEGER) AS label, ", 1).replace("SELECT day % 7, row", "SELECT label, row").replace("PARTITION BY day % 7", "PARTITION BY label")
HOT = f"""{DAILY},
limits AS (SELECT label, quantile_cont(value, 0.8) AS threshold, max(value) AS highest FROM kde WHERE value > 0 GROUP BY label),
hot AS (SELECT k.*, threshold, highest, CAST(value >= threshold AS INTEGER) AS hot FROM kde k JOIN limits USING (label) WHERE value > 0)"""


def hot(spark, sf_dir) -> DataFrame:
    d = kde_days(spark, sf_dir)
    return grids.daily_hotspots(d, WEEK.hotspot_top_fraction)


def kde_days(spark, sf_dir) -> DataFrame:
    return grids.density(grids.histogram(projected(spark, sf_dir), GRID, None, ["label"]), GRID, RADIUS, ["label"])


@query("SP16_daily_density", f"{DAILY} SELECT label, row, col, round(value, 6) AS value FROM kde")
def daily_density(spark, sf_dir):
    return kde_days(spark, sf_dir).withColumn("value", F.round("value", 6))


@query("A4_thresholds", f"{HOT} SELECT label, round(threshold, 6) AS threshold, round(highest, 6) AS highest FROM limits")
def thresholds(spark, sf_dir):
    return hot(spark, sf_dir).select("label", F.round("threshold", 6).alias("threshold"), F.round("highest", 6).alias("highest")).distinct()


PERSIST = f"{HOT}, lasting AS (SELECT row, col, CAST(sum(hot) AS INTEGER) AS persistence, sum(value / threshold) / 7 AS mean_norm FROM hot GROUP BY ALL)"


@query("SP17_persistence", f"{PERSIST} SELECT row, col, persistence, round(mean_norm, 6) AS mean_norm FROM lasting")
def persistence(spark, sf_dir):
    return grids.persistence(hot(spark, sf_dir), 7).withColumn("mean_norm", F.round("mean_norm", 6))


@query("A6_persistence_counts", f"{PERSIST} SELECT persistence, count(*) AS n FROM lasting GROUP BY ALL")
def persistence_counts(spark, sf_dir):
    return grids.persistence(hot(spark, sf_dir), 7).groupBy("persistence").agg(F.count(F.lit(1)).alias("n"))


COMPONENTS = f"""{PERSIST.replace('WITH pings', 'WITH RECURSIVE pings', 1)},
core AS (SELECT row, col, row * 100000 + col AS id, persistence, mean_norm FROM lasting WHERE persistence >= 3),
reach(id, other) AS (
  SELECT id, id FROM core UNION SELECT r.id, b.id FROM reach r JOIN core a ON a.id = r.other JOIN core b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1
),
first_ AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
labels AS (SELECT row, col, persistence, mean_norm, dense_rank() OVER (ORDER BY component) AS label FROM core JOIN first_ USING (id))"""


def core(spark, sf_dir) -> DataFrame:
    return grids.persistence(hot(spark, sf_dir), 7).where("persistence >= 3")


@query("SP18_raster_components", f"{COMPONENTS} SELECT row, col, label FROM labels")
def raster_components(spark, sf_dir):
    return graphs.raster_components(core(spark, sf_dir))


@query(
    "A7_regions",
    f"""{COMPONENTS}
SELECT row_number() OVER (ORDER BY avg(mean_norm) DESC, count(*) DESC, label) AS rank, count(*) AS n_cells, CAST(round(count(*) * {GRID.cell**2 / 1e6!r}, 6) AS DOUBLE) AS area_km2, round(avg(persistence), 6) AS mean_persistence,
  round(avg(mean_norm), 6) AS mean_density_norm, round(avg({GRID.xmin} + (col + 0.5) * {GRID.cell}), 3) AS center_x, round(avg({GRID.ymax} - (row + 0.5) * {GRID.cell}), 3) AS center_y
FROM labels GROUP BY label HAVING count(*) >= 3""",
)
def regions(spark, sf_dir):
    c = core(spark, sf_dir)
    d = grids.regions(c, graphs.raster_components(c), GRID)
    rounded = {"area_km2": 6, "mean_persistence": 6, "mean_density_norm": 6, "center_x": 3, "center_y": 3}
    return d.select(F.col("rank").cast("long").alias("rank"), "n_cells", *[F.round(k, n).alias(k) for k, n in rounded.items()])


@query(
    "O5_ranked",
    f"""{COMPONENTS} SELECT row_number() OVER (ORDER BY avg(mean_norm) DESC, count(*) DESC, label) AS rank, label, count(*) AS n_cells FROM labels GROUP BY label""",
)
def ranked(spark, sf_dir):
    c = core(spark, sf_dir)
    return grids.regions(c, graphs.raster_components(c), GRID, 1).select(F.col("rank").cast("long").alias("rank"), "label", "n_cells")


@query(
    "SP20_polygons",
    f"""{COMPONENTS} SELECT label, 'MULTIPOLYGON (' || string_agg('((' || w || ' ' || s || ', ' || e || ' ' || s || ', ' || e || ' ' || n || ', ' || w || ' ' || n || ', ' || w || ' ' || s || '))', ', ' ORDER BY row, col) || ')' AS wkt
FROM (SELECT *, CAST({GRID.xmin} + col * {GRID.cell} AS DOUBLE) AS w, CAST({GRID.xmin} + (col + 1) * {GRID.cell} AS DOUBLE) AS e, CAST({GRID.ymax} - (row + 1) * {GRID.cell} AS DOUBLE) AS s, CAST({GRID.ymax} - row * {GRID.cell} AS DOUBLE) AS n FROM labels) GROUP BY label HAVING count(*) >= 3""",
)
def polygons(spark, sf_dir):
    c = core(spark, sf_dir)
    return grids.regions(c, graphs.raster_components(c), GRID).select("label", grids.multipolygon(F.col("cells"), GRID).alias("wkt"))


STAR = f"""{CTE}, {HEXED},
stats AS (SELECT CAST(day % 7 AS INTEGER) AS label, q, r, CAST(count(*) AS DOUBLE) AS v FROM hexed GROUP BY ALL),
every AS (SELECT c.q, c.r, d.label, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT q, r FROM stats) c CROSS JOIN (SELECT DISTINCT label FROM stats) d LEFT JOIN stats s ON s.q = c.q AND s.r = c.r AND s.label = d.label),
whole AS (SELECT label, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd FROM every GROUP BY label),
steps(a, b) AS (VALUES (0, 0), (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)),
local AS (SELECT e.label, e.q, e.r, sum(o.v) AS s, count(*) AS w FROM every e, steps JOIN every o ON o.label = e.label AND o.q = e.q + a AND o.r = e.r + b GROUP BY ALL),
star AS (
  SELECT e.q, e.r, e.label, e.v, CASE WHEN sd > 0 AND n * w - w * w > 0 THEN (s - m * w) / (sd * sqrt((n * w - w * w) / (n - 1.0))) ELSE 0 END AS z
  FROM every e JOIN local l ON e.label = l.label AND e.q = l.q AND e.r = l.r JOIN whole h ON h.label = e.label
)"""


def day_stats(spark, sf_dir) -> DataFrame:
    d = T.with_hexagon(featured(spark, sf_dir), DEFAULT.hex_size_m)
    return d.groupBy((F.col("day") % 7).cast("int").alias("label"), "q", "r").agg(F.count(F.lit(1)).cast("double").alias("v"))


@query("J12_aligned_days", f"{STAR} SELECT q, r, label, v FROM every")
def aligned_days(spark, sf_dir):
    return grids.align_days(day_stats(spark, sf_dir), "v")


@query("SP22_gi_star", f"{STAR} SELECT q, r, label, v, round(z, 6) AS gi_star FROM star")
def gi_star(spark, sf_dir):
    d = grids.gi_star(grids.align_days(day_stats(spark, sf_dir), "v"), "v")
    return d.withColumn("gi_star", F.round("gi_star", 6))


MK = f"""{STAR},
s AS (SELECT a.q, a.r, sum(sign(b.v - a.v)) AS s FROM every a JOIN every b ON a.q = b.q AND a.r = b.r AND a.label < b.label GROUP BY ALL),
days AS (SELECT count(DISTINCT label) AS n FROM every),
mk AS (SELECT q, r, CASE WHEN s > 0 THEN (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) WHEN s < 0 THEN (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) ELSE 0 END AS z FROM s, days)"""


@query("SP23_mann_kendall", f"{MK} SELECT q, r, round(z, 6) AS mk_trend_z FROM mk")
def mann_kendall(spark, sf_dir):
    return grids.space_time_clusters(day_stats(spark, sf_dir), "v").select("q", "r", F.round("mk_trend_z", 6).alias("mk_trend_z"))


CLASSES = f"""{MK},
counted AS (
  SELECT q, r, count(*) AS n, count(*) FILTER (z > 1.0) AS hot, count(*) FILTER (z < -1.0) AS cold,
    coalesce(max(label) FILTER (z <= 1.0), -1) AS last_off, count(*) FILTER (z > 1.0) AS all_hot FROM star GROUP BY ALL
),
tail AS (SELECT c.*, (SELECT count(*) FROM star s WHERE s.q = c.q AND s.r = c.r AND s.label > c.last_off) AS tail_run FROM counted c),
classes AS (
  SELECT t.q, t.r, CASE WHEN hot = 0 AND cold = 0 THEN 'no_pattern_detected' WHEN hot > 0 AND cold > 0 THEN 'oscillating_hotspot' WHEN hot = n AND m.z > 1.0 THEN 'intensifying_hotspot'
    WHEN hot = n AND m.z < -1.0 THEN 'diminishing_hotspot' WHEN hot = n THEN 'persistent_hotspot' WHEN cold = n THEN 'persistent_coldspot'
    WHEN hot > 0 AND tail_run = hot AND tail_run >= 2 THEN 'consecutive_hotspot' WHEN hot > 0 THEN 'sporadic_hotspot' ELSE 'sporadic_coldspot' END AS category
  FROM tail t JOIN mk m ON t.q = m.q AND t.r = m.r
)"""


@query("SP24_patterns", f"{CLASSES} SELECT * FROM classes")
def patterns(spark, sf_dir):
    return grids.space_time_clusters(day_stats(spark, sf_dir), "v", alpha=1.0).select("q", "r", "category")


@query("A8_category_counts", f"{CLASSES} SELECT category, count(*) AS n FROM classes GROUP BY ALL")
def category_counts(spark, sf_dir):
    return patterns(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "U6_day_pivot",
    f"{STAR} SELECT q, r, " + ", ".join(f"CAST(sum(v) FILTER (label = {d}) AS DOUBLE) AS value_{d}" for d in range(7)) + " FROM every GROUP BY ALL",
)
def day_pivot(spark, sf_dir):
    d = grids.align_days(day_stats(spark, sf_dir), "v").groupBy("q", "r").pivot("label", list(range(7))).agg(F.sum("v"))
    return d.select("q", "r", *[F.col(str(i)).alias(f"value_{i}") for i in range(7)])


@query(
    "SP19_hex_components",
    f"""{STAR.replace('WITH pings', 'WITH RECURSIVE pings', 1)},
hotcell AS (SELECT q, r, q * 4294967296 + r + 2147483648 AS id FROM star WHERE label = 6 AND z > 0.3),
reach(id, other) AS (
  SELECT id, id FROM hotcell UNION
  SELECT x.id, b.id FROM reach x JOIN hotcell a ON a.id = x.other JOIN hotcell b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
),
first_ AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
size AS (SELECT component, count(*) AS n_cells, row_number() OVER (ORDER BY count(*) DESC, component) AS cluster_id FROM first_ GROUP BY component)
SELECT q, r, cluster_id, n_cells FROM hotcell JOIN first_ USING (id) JOIN size USING (component)""",
)
def hex_components(spark, sf_dir):
    d = grids.gi_star(grids.align_days(day_stats(spark, sf_dir), "v"), "v").where("label = 6 and gi_star > 0.3")
    return graphs.hex_components(d)


@query("S15_preview", kde_sql("true") + " SELECT row, col, round(ln(1 + value), 6) AS shade FROM kde WHERE value > 0 AND value >= (SELECT quantile_cont(value, 0.25) FROM kde WHERE value > 0)")
def preview(spark, sf_dir):
    d = grids.density(grids.histogram(projected(spark, sf_dir), GRID), GRID, RADIUS)
    return grids.preview(d).withColumn("shade", F.round("shade", 6))


#: Areas of the city, in degrees and in an order, whose sides no ping meets: a box and a triangle that overlap.
DISTRICTS = [("west", [(116.3910037, 39.8910041), (116.4030037, 39.8910041), (116.4030037, 39.9090041), (116.3910037, 39.9090041)]), ("corner", [(116.4000037, 39.9000041), (116.4100037, 39.9000041), (116.4100037, 39.9100093)])]
#: Areas whose sides and corners are met.
BLOCKS = [("a", [(2, 2), (6, 2), (6, 6), (2, 6)]), ("b", [(4, 4), (9, 4), (9, 9)])]


def ring(points: list[tuple[float, float]]):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def areas(spark, named: list[tuple]) -> DataFrame:
    rows = [(i, name, [(float(x), float(y)) for x, y in points]) for i, (name, points) in enumerate(named)]
    kind = "int" if named and isinstance(named[0][0], int) else "string"
    return spark.createDataFrame(rows, f"ord int, name {kind}, points array<struct<x:double,y:double>>")


EVENT_XY = "SELECT event_id AS src_seq, 116.40 + ((event_id * 7919) % 2001 - 1000) * CAST(1e-5 AS DOUBLE) AS x, 39.90 + ((event_id * 104729) % 2001 - 1000) * CAST(1e-5 AS DOUBLE) AS y FROM events"


@query(
    "J5_districts",
    f"""SELECT src_seq, CASE WHEN x < 116.4100037 AND y > 39.9000041 AND (39.9100093 - 39.9000041) * (x - 116.4000037) > (116.4100037 - 116.4000037) * (y - 39.9000041) THEN 'corner'
  WHEN x > 116.3910037 AND x < 116.4030037 AND y > 39.8910041 AND y < 39.9090041 THEN 'west' ELSE 'unknown' END AS district FROM ({EVENT_XY})""",
)
def districts(spark, sf_dir):
    d = with_area(pings(spark, sf_dir), areas(spark, DISTRICTS), F.col("longitude"), F.col("latitude"), 0.002, "district", F.lit("unknown"))
    return d.select("src_seq", "district")


@query(
    "J5_borders",
    "SELECT event_id, CASE WHEN x < 9 AND y > 4 AND x - 4 > y - 4 THEN 'b' WHEN x > 2 AND x < 6 AND y > 2 AND y < 6 THEN 'a' ELSE 'unknown' END AS district FROM (SELECT event_id, event_id % 11 AS x, user_id % 11 AS y FROM events)",
)
def borders(spark, sf_dir):
    """Sides and corners lie outside."""
    x, y = (F.col("event_id") % 11).cast("double"), (F.col("user_id") % 11).cast("double")
    return with_area(table(spark, sf_dir, "events"), areas(spark, BLOCKS), x, y, 1.5, "district", F.lit("unknown")).select("event_id", "district")


@query(
    "J6_regions",
    "SELECT event_id, CASE WHEN x <= 9 AND y >= 4 AND x - 4 >= y - 4 THEN 2 WHEN x BETWEEN 2 AND 6 AND y BETWEEN 2 AND 6 THEN 1 ELSE -1 END AS candidate_rank FROM (SELECT event_id, event_id % 11 AS x, user_id % 11 AS y FROM events)",
)
def regions_of_points(spark, sf_dir):
    """Sides and corners lie inside; of several regions the last."""
    x, y = (F.col("event_id") % 11).cast("double"), (F.col("user_id") % 11).cast("double")
    ranked_ = areas(spark, [(i, points) for i, (_, points) in enumerate(BLOCKS, 1)])
    return with_area(table(spark, sf_dir, "events"), ranked_, x, y, 1.5, "candidate_rank", F.lit(-1), True).select("event_id", "candidate_rank")


#: Small areas of the city, as boxes.
STUDY = [(116.3920013, 39.8920017, 116.3950013, 39.8960017), (116.4010013, 39.9030017, 116.4020013, 39.9080017), (116.4071013, 39.8911017, 116.4074013, 39.8914017)]


def _clip(axis: str, low: str, high: str) -> tuple[str, str]:
    """From where to where along it a leg lies within a strip."""
    a, d = f"p{axis}", f"({axis} - p{axis})"
    inside = f"{a} BETWEEN {low} AND {high}"
    return (
        f"CASE WHEN {d} = 0 THEN CASE WHEN {inside} THEN 0 ELSE 2 END ELSE least(({low} - {a}) / {d}, ({high} - {a}) / {d}) END",
        f"CASE WHEN {d} = 0 THEN CASE WHEN {inside} THEN 1 ELSE -1 END ELSE greatest(({low} - {a}) / {d}, ({high} - {a}) / {d}) END",
    )


@query(
    "J10_lines_in_areas",
    f"""{POINTS}, leg AS (SELECT route_id, longitude AS x, latitude AS y, lag(longitude) OVER r AS px, lag(latitude) OVER r AS py FROM points WINDOW r AS (PARTITION BY route_id ORDER BY seq)),
box(x0, y0, x1, y1) AS (VALUES {', '.join(map(str, STUDY))}),
cut AS (SELECT route_id, greatest(0, {_clip('x', 'x0', 'x1')[0]}, {_clip('y', 'y0', 'y1')[0]}) <= least(1, {_clip('x', 'x0', 'x1')[1]}, {_clip('y', 'y0', 'y1')[1]}) AS hit FROM leg, box WHERE px IS NOT NULL)
SELECT route_id, CAST(bool_or(hit) AS INTEGER) AS in_area FROM cut GROUP BY route_id""",
)
def lines_in_areas(spark, sf_dir):
    boxes = areas(spark, [(str(i), [(a, b), (c, b), (c, d), (a, d)]) for i, (a, b, c, d) in enumerate(STUDY)])
    return flagged(T.lines(gated_points(spark, sf_dir)), "route_id", "points", boxes, 0.002).select("route_id", "in_area")


@query(
    "J11_regions_of_districts",
    """SELECT c_custkey, arg_min(n_name, n_nationkey) AS area FROM (SELECT c_custkey, c_custkey * 37 % 230 AS x, c_custkey * 91 % 230 AS y FROM customer) r
LEFT JOIN (SELECT n_nationkey, n_name, n_nationkey % 5 * 40 AS a, n_nationkey // 5 * 40 AS b FROM nation) n ON x <= a + 40 AND x + 3 >= a AND y <= b + 40 AND y + 3 >= b GROUP BY c_custkey""",
)
def regions_of_districts(spark, sf_dir):
    """Squares of three units against districts that share their borders: the first that a square touches."""
    def square(x, y, side):
        at = lambda i, j: F.struct((x + i * side).cast("double").alias("x"), (y + j * side).cast("double").alias("y"))
        return F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))

    n, c = F.col("n_nationkey"), F.col("c_custkey")
    nations = table(spark, sf_dir, "nation").select(n.cast("int").alias("ord"), F.col("n_name").alias("name"), square(n % 5 * 40, F.floor(n / 5) * 40, 40).alias("points"))
    regions_ = table(spark, sf_dir, "customer").select("c_custkey", square(c * 37 % 230, c * 91 % 230, 3).alias("points"))
    return first_area(regions_, "c_custkey", "points", nations, 20.0).select("c_custkey", "area")


@query(
    "SP29_fishnet",
    f"""{XY.replace('WITH pings', 'WITH pings', 1)},
legs AS (SELECT taxi_id, src_seq, CAST(timestamp // 3600 AS BIGINT) AS hour, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2, trip_break FROM xy {'WINDOW w AS (PARTITION BY taxi_id ORDER BY timestamp, src_seq)'}),
whole AS (SELECT * FROM legs WHERE trip_break = 0),
t0 AS (
  SELECT src_seq, 0.0 AS t FROM whole UNION SELECT src_seq, 1.0 FROM whole
  UNION SELECT src_seq, (k * 500.0 - x1) / (x2 - x1) FROM whole, (SELECT unnest(range(880, 910)) AS k) WHERE k * 500.0 > least(x1, x2) AND k * 500.0 < greatest(x1, x2)
  UNION SELECT src_seq, (k * 500.0 - y1) / (y2 - y1) FROM whole, (SELECT unnest(range(8800, 8860)) AS k) WHERE k * 500.0 > least(y1, y2) AND k * 500.0 < greatest(y1, y2)
),
t1 AS (SELECT src_seq, t AS a, lead(t) OVER (PARTITION BY src_seq ORDER BY t) AS b FROM t0)
SELECT hour, CAST(floor((y1 + (a + b) / 2 * (y2 - y1)) / 500) AS BIGINT) AS row, CAST(floor((x1 + (a + b) / 2 * (x2 - x1)) / 500) AS BIGINT) AS col, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * (b - a)), 3) AS metres
FROM whole JOIN t1 USING (src_seq) WHERE b IS NOT NULL GROUP BY ALL""",
)
def fishnet(spark, sf_dir):
    d = projected(spark, sf_dir)
    before = lambda c: F.lag(c).over(T.by_time())
    d = d.select(F.floor(F.col("timestamp") / 3600).cast("long").alias("hour"), before("x").alias("x1"), before("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"), "trip_break").where("trip_break = 0")
    return grids.fishnet_lengths(d, 500.0, ["hour"]).withColumn("metres", F.round("metres", 3))


WEST = [(116.391, 39.891), (116.4, 39.891), (116.4, 39.909), (116.391, 39.909)]
BOX = [(116.395, 39.895), (116.405, 39.895), (116.405, 39.905), (116.395, 39.905)]


@query("F3_inside_boundary", f"SELECT src_seq FROM ({EVENT_XY}) WHERE x > 116.395 AND x < 116.405 AND y > 39.895 AND y < 39.905")
def inside_boundary(spark, sf_dir):
    return pings(spark, sf_dir).where(geometry.in_ring(F.col("longitude"), F.col("latitude"), ring(BOX))).select("src_seq")


@query("SP2_union_of_rings", f"SELECT src_seq FROM ({EVENT_XY}) WHERE (x > 116.395 AND x < 116.405 AND y > 39.895 AND y < 39.905) OR (x > 116.391 AND x < 116.4 AND y > 39.891 AND y < 39.909)")
def union_of_rings(spark, sf_dir):
    x, y = F.col("longitude"), F.col("latitude")
    inside = geometry.in_ring(x, y, ring(BOX)) | geometry.in_ring(x, y, ring(WEST))
    return pings(spark, sf_dir).where(inside).select("src_seq")


@query(
    "J13_hex_neighbours",
    f"{CTE}, {HEXED}, c AS (SELECT q, r, count(*) AS n FROM hexed GROUP BY ALL), s(a, b) AS (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) "
    "SELECT c.q, c.r, CAST(sum(o.n) AS BIGINT) AS around FROM c, s JOIN c o ON o.q = c.q + a AND o.r = c.r + b GROUP BY ALL",
)
def hex_neighbours(spark, sf_dir):
    c = T.with_hexagon(featured(spark, sf_dir), DEFAULT.hex_size_m).groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"))
    near = c.select("n", F.explode(hexgrid.neighbours(F.col("q"), F.col("r"))).alias("c")).groupBy(F.col("c.q").alias("q"), F.col("c.r").alias("r")).agg(F.sum("n").alias("around"))
    return near.join(c, ["q", "r"], "left_semi")


@query("O7_hot_cells", f"{HOT} SELECT label, row, col FROM hot WHERE hot = 1")
def hot_cells(spark, sf_dir):
    return hot(spark, sf_dir).where("hot = 1").select("label", "row", "col")


@query(
    "J15_band_stack",
    f"""{XY}, a AS (SELECT {CELL}, count(*) AS n FROM xy WHERE {INSIDE} AND occupied = 1 GROUP BY ALL), b AS (SELECT {CELL}, count(*) AS n FROM xy WHERE {INSIDE} AND occupied = 0 GROUP BY ALL)
SELECT 1 AS band_idx, 'occupied' AS label, row, col, CAST(n AS DOUBLE) AS value FROM a UNION ALL SELECT 2, 'empty', row, col, CAST(n AS DOUBLE) FROM b""",
)
def band_stack(spark, sf_dir):
    d = projected(spark, sf_dir)
    return grids.stack({"occupied": grids.histogram(d.where("occupied = 1"), GRID), "empty": grids.histogram(d.where("occupied = 0"), GRID)})


@query(
    "SP29_zero_filled_cube",
    f"""{XY}, c AS (SELECT row, col, hour, CAST(count(*) AS DOUBLE) AS value FROM (SELECT {CELL}, CAST((timestamp + 28800) % 86400 // 3600 AS BIGINT) AS hour FROM xy WHERE {INSIDE}) GROUP BY ALL),
e AS (SELECT row, col, unnest(range(6, 13)) AS hour FROM (SELECT DISTINCT row, col FROM c))
SELECT row, col, hour, coalesce(value, 0) AS value FROM e LEFT JOIN c USING (row, col, hour)""",
)
def zero_filled_cube(spark, sf_dir):
    d = projected(spark, sf_dir).withColumn("hour", F.floor(F.pmod(F.col("timestamp") + 28800, F.lit(86400)) / 3600).cast("long"))
    return grids.zero_filled(grids.histogram(d, GRID, None, ["hour"]), ["row", "col"], "hour", "value", 6, 12, 1)

"""Queries of functions that others only use along the way, each by itself, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import geometry, hexgrid, scalars
from ..operators import graphs, grids
from ..operators import network as N
from ..operators import relational as R
from ..sources.pings import FROM_EVENTS_SQL
from .network import LATTICE, ROUTED, STEP, lattice, segments, snapped_ends
from .registry import query
from .spatial import COMPONENTS, GRID, HOT, RADIUS, STAR, core, day_stats, hot, ring
from .trajectory import hav, pings, table

def e():
    return F.col("event_id")


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def _column(name: str, sql: str, column) -> None:
    """A column of the events as result, and its SQL."""

    @query(name, f"SELECT event_id, {sql} AS result FROM events")
    def single(spark, sf_dir):
        return events(spark, sf_dir).select("event_id", column().alias("result"))


def line(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def _pick(values: list, by: int, shift: int = 0):
    return F.element_at(F.array(*map(F.lit, values)), ((e() + shift) % by + 1).cast("int"))


LAT, LON = "(event_id * 7919 % 17900 - 8950) / 100.0", "(event_id * 104729 % 36000 - 18000) / 100.0"
lat = lambda: (e() * 7919 % 17900 - 8950) / 100.0
lon = lambda: (e() * 104729 % 36000 - 18000) / 100.0

_column("X1_haversine", f"round({hav(LAT, LON, '39.9', '116.4')}, 3)", lambda: F.round(scalars.haversine_m(lat(), lon(), F.lit(39.9), F.lit(116.4)), 3))
_column("X2_heading_difference", "CAST(least((event_id % 720 - event_id * 7 % 360 + 720) % 360, 360 - (event_id % 720 - event_id * 7 % 360 + 720) % 360) AS DOUBLE)", lambda: scalars.heading_delta((e() * 7 % 360).cast("double"), (e() % 720).cast("double")))
_column("X3_speed", "CASE WHEN event_id % 5 > 0 THEN round(event_id % 1000 / (event_id % 5) * 3.6, 2) END", lambda: scalars.speed_kmh((e() % 1000).cast("double"), (e() % 5).cast("double")))
_column("X4_reported_speed", "CASE event_id % 6 WHEN 0 THEN 12.5 WHEN 1 THEN NULL WHEN 2 THEN 7.0 WHEN 3 THEN NULL WHEN 4 THEN -0.5 ELSE NULL END::DOUBLE", lambda: scalars.parse_number(_pick(["12.5", "12f", " 7 ", "", "-.5", None], 6)))
_column("X5_hour", "CAST((event_id * 977 + 28800) % 86400 // 3600 AS INTEGER)", lambda: scalars.hour_of_day(e() * 977))
_column("X10_level", "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 45 > 30 THEN '畅通' WHEN event_id % 45 > 20 THEN '轻度拥挤' WHEN event_id % 45 > 10 THEN '拥挤' ELSE '严重拥挤' END", lambda: scalars.congestion_level(F.when(e() % 7 != 0, (e() % 45).cast("double"))))
_column("X11_plausible_trip", "event_id * 31 % 90000 - 1000 > 0 AND event_id * 31 % 90000 - 1000 <= 86400 AND event_id % 500 <= (event_id * 31 % 90000 - 1000) / 3600.0 * 150", lambda: scalars.plausible_trip((e() * 31 % 90000 - 1000).cast("double"), (e() % 500).cast("double")))
_column("X12_plausible_ride", "event_id * 7 % 8000 BETWEEN 30 AND 7200 AND (event_id % 9 = 0 OR event_id % 150 <= 120)", lambda: scalars.plausible_ride(e() * 7 % 8000, F.when(e() % 9 != 0, (e() % 150).cast("double"))))
_column("X13_parked", "CAST(event_id % 3600 > 1800 AS INTEGER)", lambda: scalars.likely_parked(e() % 3600))
_column("X14_route_id", "'2017030' || (event_id % 7 + 1) || '_' || event_id", lambda: scalars.route_id(F.concat(F.lit("2017-03-0"), (e() % 7 + 1).cast("string")), e()))
_column("X16_one_way", "CASE event_id % 7 WHEN 1 THEN 'F' WHEN 2 THEN 'T' WHEN 3 THEN 'F' ELSE 'B' END", lambda: scalars.one_way(_pick(["B", "f", " T ", "F", "None", "", None], 7)))
_column("X17_node_key", "CAST(event_id % 5000 AS VARCHAR) || ':' || CAST(-(event_id % 700) * 1000 AS VARCHAR)", lambda: scalars.node_key((e() % 5000) / 1000.0, -(e() % 700).cast("double")))
_column("X18_truthy", "event_id % 8 IN (0, 1, 2, 3)", lambda: scalars.truthy(_pick([" TRUE", "1", "y ", "Yes", "0", "no", "", None], 8)))
_column("SP1_strictly_inside", "event_id % 13 - 2 < 3 * (user_id % 13 - 2) AND user_id % 13 - 2 < 3 * (event_id % 13 - 2) AND (event_id % 13 - 2) + (user_id % 13 - 2) < 8", lambda: geometry.in_ring((e() % 13 - 2).cast("double"), (F.col("user_id") % 13 - 2).cast("double"), ring([(0, 0), (6, 2), (2, 6)])))
_column(
    "SP27_along_a_segment",
    "round(least(greatest((event_id % 50 * 3 + event_id % 40 * 4) / 5.0, 0), 50), 9)",
    lambda: F.round(geometry.point_segment((e() % 50).cast("double"), (e() % 40).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(40.0))[1], 9),
)
_column(
    "SP26_line_status",
    "CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'zero_length' WHEN 2 THEN 'invalid_geometry' WHEN 3 THEN 'invalid_geometry' ELSE 'invalid_geometry' END",
    lambda: geometry.line_status(F.when(e() % 5 == 0, line((1, 1), (2, 2))).when(e() % 5 == 1, line((1, 1), (1, 1))).when(e() % 5 == 2, line((1, 1))).when(e() % 5 == 3, line((1, 1), (float("nan"), 2)))),
)


@query("SP4_circumradius", "SELECT size, round(sqrt(size * size / (1.5 * sqrt(3))), 9) AS radius FROM (SELECT CAST(size AS DOUBLE) AS size FROM (VALUES (100), (300), (1000)) t(size))")
def circumradius(spark, sf_dir):
    return spark.createDataFrame([(s, round(hexgrid.circumradius(s), 9)) for s in (100.0, 300.0, 1000.0)], "size double, radius double")


AXIAL = f"SELECT event_id, (x * {hexgrid.SQRT3 / 3!r} - y / 3.0) / {hexgrid.circumradius(300.0)!r} AS qf, y * {2 / 3!r} / {hexgrid.circumradius(300.0)!r} AS rf FROM (SELECT event_id, (event_id * 37 % 9973 - 4986) * 1.0 AS x, (event_id * 101 % 9967 - 4983) * 1.0 AS y FROM events)"


@query(
    "SP5_axial",
    f"""WITH a AS ({AXIAL}), n AS (SELECT *, round_even(qf, 0) AS q, round_even(rf, 0) AS r, round_even(-qf - rf, 0) AS s FROM a),
d AS (SELECT *, abs(q - qf) AS dq, abs(r - rf) AS dr, abs(s + qf + rf) AS ds FROM n)
SELECT event_id, CAST(CASE WHEN dq > dr AND dq > ds THEN -r - s ELSE q END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN r WHEN dr >= ds THEN -q - s ELSE r END AS BIGINT) AS r FROM d""",
)
def axial(spark, sf_dir):
    d = events(spark, sf_dir).select("event_id", (e() * 37 % 9973 - 4986).cast("decimal(10,1)").alias("x"), (e() * 101 % 9967 - 4983).cast("decimal(10,1)").alias("y"))
    return hexgrid.with_axial(d, 300.0).select("event_id", "q", "r")


@query("SP8_neighbours", "SELECT q, r, q + a AS nq, r + b AS nr FROM (SELECT DISTINCT event_id % 50 AS q, user_id % 20 - 10 AS r FROM events), (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) s(a, b)")
def neighbours(spark, sf_dir):
    d = events(spark, sf_dir).select((e() % 50).alias("q"), (F.col("user_id") % 20 - 10).alias("r")).distinct()
    return d.select("q", "r", F.explode(hexgrid.neighbours(F.col("q"), F.col("r"))).alias("n")).select("q", "r", F.col("n.q").alias("nq"), F.col("n.r").alias("nr"))


@query(
    "SP11_kernel",
    f"""WITH o AS (SELECT a.i, b.i AS j FROM range(-4, 5) a(i), range(-4, 5) b(i)), k AS (SELECT i, j, (i * i + j * j) / pow({RADIUS} / {GRID.cell}, 2) AS t FROM o)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(pow(1 - t, 2) * 3 / (pi() * pow({RADIUS} / {GRID.cell}, 2)), 9) AS w FROM k WHERE t < 1""",
)
def kernel(spark, sf_dir):
    return spark.createDataFrame([(i, j, round(w, 9)) for i, j, w in grids.kernel(RADIUS, GRID.cell)], "i int, j int, w double")


@query(
    "SP12_convolution",
    """WITH h AS (SELECT 29 - user_id % 30 AS row, event_id % 40 AS col, sum(CAST(value AS DOUBLE)) AS v FROM events GROUP BY ALL),
k AS (SELECT a.i, b.i AS j, pow(1 - (a.i * a.i + b.i * b.i) / 6.25, 2) * 3 / (pi() * 6.25) AS w FROM range(-3, 4) a(i), range(-3, 4) b(i) WHERE a.i * a.i + b.i * b.i < 6.25),
s AS (SELECT row + i AS row, col + j AS col, sum(v * w) AS value FROM h, k WHERE row + i BETWEEN 0 AND 29 AND col + j BETWEEN 0 AND 39 GROUP BY ALL)
SELECT row, col, round(value * 100, 6) AS value FROM s WHERE value >= (SELECT max(value) FROM s) * 1e-6""",
)
def convolution(spark, sf_dir):
    """Sums of values on a grid of 30 by 40 cells of 100 m, spread over 250 m."""
    grid = grids.Grid(0, 0, 4000, 3000, 100.0)
    d = events(spark, sf_dir).select(((e() % 40) * 100 + 50).cast("double").alias("x"), ((F.col("user_id") % 30) * 100 + 50).cast("double").alias("y"), F.col("value").cast("double").alias("v"))
    return grids.density(grids.histogram(d, grid, "v"), grid, 250.0).withColumn("value", F.round("value", 6))


@query("SP13_grid", "SELECT name, CAST(value AS DOUBLE) AS value FROM (VALUES ('xmin', -150.0), ('ymin', 0.0), ('xmax', 1050.0), ('ymax', 450.0), ('width', 8.0), ('height', 3.0)) t(name, value)")
def grid_spec(spark, sf_dir):
    """Snapped outward to whole cells."""
    g = grids.Grid.around(-1.0, 0.0, 901.0, 301.0, 150.0)
    return spark.createDataFrame([(n, float(getattr(g, n))) for n in ("xmin", "ymin", "xmax", "ymax", "width", "height")], "name string, value double")


@query(
    "SP21_areas",
    f"{COMPONENTS} SELECT label, CAST(round(count(*) * {GRID.cell**2 / 1e6!r}, 6) AS DOUBLE) AS area_km2, round(avg({GRID.xmin} + (col + 0.5) * {GRID.cell}), 3) AS center_x, round(avg({GRID.ymax} - (row + 0.5) * {GRID.cell}), 3) AS center_y FROM labels GROUP BY label",
)
def areas(spark, sf_dir):
    c = core(spark, sf_dir)
    d = grids.regions(c, graphs.raster_components(c), GRID, 1)
    return d.select("label", *[F.round(k, n).alias(k) for k, n in (("area_km2", 6), ("center_x", 3), ("center_y", 3))])


@query("A5_over_the_highest", f"{HOT} SELECT row, col, CAST(sum(hot) AS INTEGER) AS persistence, round(sum(value / highest) / 7, 6) AS mean_norm FROM hot GROUP BY ALL")
def over_the_highest(spark, sf_dir):
    """The older variant: densities over each day's highest."""
    return grids.persistence(hot(spark, sf_dir), 7, script=True).withColumn("mean_norm", F.round("mean_norm", 6))


@query(
    "O6_largest_first",
    f"""{STAR.replace('WITH pings', 'WITH RECURSIVE pings', 1)},
cell AS (SELECT q, r, q * 4294967296 + r + 2147483648 AS id FROM star WHERE label = 6 AND z > 0.1),
reach(id, other) AS (
  SELECT id, id FROM cell UNION SELECT x.id, b.id FROM reach x JOIN cell a ON a.id = x.other JOIN cell b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
),
sizes AS (SELECT component, count(*) AS n_cells FROM (SELECT id, min(other) AS component FROM reach GROUP BY id) GROUP BY component)
SELECT row_number() OVER (ORDER BY n_cells DESC, component) AS cluster_id, n_cells FROM sizes""",
)
def largest_first(spark, sf_dir):
    z = grids.gi_star(grids.align_days(day_stats(spark, sf_dir), "v"), "v").where("label = 6 and gi_star > 0.1")
    return graphs.hex_components(z).select("cluster_id", "n_cells").distinct()


@query("O1_sorted", f"WITH pings AS ({FROM_EVENTS_SQL}) SELECT taxi_id, timestamp, src_seq, row_number() OVER (ORDER BY taxi_id, timestamp, src_seq) AS place FROM pings")
def sorted_pings(spark, sf_dir):
    """By the vehicle's id as text, then time; ties keep their order."""
    return R.stable_order(pings(spark, sf_dir).select("taxi_id", "timestamp", "src_seq"), ["taxi_id", "timestamp", "src_seq"])


@query(
    "J14_lengths_in_cells",
    f"""WITH {LATTICE}, piece AS (
  SELECT row0 AS row, c AS col, least(x2, (c + 1) * 100.0) - greatest(x1, c * 100.0) AS m FROM (SELECT *, CAST(floor(y1 / 100.0) AS BIGINT) AS row0 FROM street WHERE y1 = y2), (SELECT unnest(range(4400, 4520)) AS c) WHERE c * 100.0 < x2 AND (c + 1) * 100.0 > x1
  UNION ALL SELECT c, col0, least(y2, (c + 1) * 100.0) - greatest(y1, c * 100.0) FROM (SELECT *, CAST(floor(x1 / 100.0) AS BIGINT) AS col0 FROM street WHERE x1 = x2), (SELECT unnest(range(44100, 44200)) AS c) WHERE c * 100.0 < y2 AND (c + 1) * 100.0 > y1
)
SELECT row, col, CAST(round(sum(m), 6) AS DOUBLE) AS metres FROM piece GROUP BY ALL""",
)
def lengths_in_cells(spark, sf_dir):
    return grids.fishnet_lengths(segments(spark), 100.0, []).withColumn("metres", F.round("metres", 6))


@query("G1_roads", f"WITH {LATTICE} SELECT osm_id, fclass, oneway, CAST({STEP} AS DOUBLE) AS metres FROM street WHERE k <> 9999 UNION ALL SELECT osm_id, fclass, oneway, 100.0 FROM street WHERE k = 9999")
def roads(spark, sf_dir):
    return N.drivable(lattice(spark)).select("osm_id", "fclass", "oneway", geometry.length(F.col("points")).alias("metres")).where("metres > 0")


@query(
    "G3_directed",
    f"""WITH {LATTICE}, way AS (SELECT road_idx, oneway, CAST(CAST(round(x1 * 1000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(y1 * 1000) AS BIGINT) AS VARCHAR) AS u, CAST(CAST(round(x2 * 1000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(y2 * 1000) AS BIGINT) AS VARCHAR) AS v FROM street)
SELECT u AS a, v AS b, road_idx FROM way WHERE oneway <> 'T' UNION ALL SELECT v, u, road_idx FROM way WHERE oneway <> 'F'""",
)
def directed(spark, sf_dir):
    return N.edges(segments(spark)).select("a", "b", "road_idx")


@query("G6_snapped_ends", f"{ROUTED} SELECT route_id, a.road_idx AS from_road, round(a.pos, 4) AS from_m, round(a.d, 4) AS from_away, b.road_idx AS to_road, round(b.pos, 4) AS to_m, round(b.d, 4) AS to_away FROM ends LEFT JOIN start_ a USING (route_id) LEFT JOIN stop_ b USING (route_id)")
def snapped(spark, sf_dir):
    t, _ = snapped_ends(spark, sf_dir)
    of = lambda s, name: [F.col(f"{s}.road_idx").alias(f"{name}_road"), F.round(f"{s}.position", 4).alias(f"{name}_m"), F.round(f"{s}.distance", 4).alias(f"{name}_away")]
    return t.select("route_id", *of("s_snap", "from"), *of("e_snap", "to"))


@query(
    "G7_doors",
    f"""{ROUTED} SELECT route_id, 'leave' AS way, CAST(node // 100000000 * 1000 AS VARCHAR) || ':' || CAST(node % 100000000 * 1000 AS VARCHAR) AS node, round(m, 4) AS metres FROM leave
UNION ALL SELECT route_id, 'arrive', CAST(node // 100000000 * 1000 AS VARCHAR) || ':' || CAST(node % 100000000 * 1000 AS VARCHAR), round(m, 4) FROM arrive""",
)
def doors(spark, sf_dir):
    t, _ = snapped_ends(spark, sf_dir)
    one = lambda s, way: t.where(F.col(s).isNotNull()).select("route_id", F.lit(way).alias("way"), F.explode(N.doors(F.col(s), way == "leave")).alias("d"))
    return R.stacked(one("s_snap", "leave"), one("e_snap", "arrive")).select("route_id", "way", "d.node", F.round("d.metres", 4).alias("metres"))


@query("G13_one_route", f"{ROUTED} SELECT route_id, round(dist_m, 4) AS dist_m, status FROM path")
def one_route(spark, sf_dir):
    """No alternatives are looked for: a row for each trip."""
    t, net = snapped_ends(spark, sf_dir)
    return N.route(t, N.edges(net), Settings(alternative_attempts=0)).select("route_id", F.round("dist_m", 4).alias("dist_m"), "status")

"""Queries of road matching, routing and detours over a lattice of streets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import projection
from ..functions.scalars import peak_label
from ..operators import network as N
from ..operators import relational as R
from ..operators import trajectory as T
from ..operators.graphs import cut_lineage
from .registry import query
from .spatial import XY, projected
from .trajectory import GATED, POINTS, gated_points, numbered

#: Corners of the lattice, metres, and streets each way.
LEFT, BOTTOM, STEP, STREETS = 447600.0, 4415600.0, 250.0, 11


def lattice(spark) -> DataFrame:
    """Streets of two points between neighbouring crossings; every fifth is one-way, every seventh that is not the other
    way; a street apart from all others can't be reached."""
    n = STREETS
    node = spark.range(n * n).select(F.col("id"), (F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j"))
    x, y = F.lit(LEFT) + F.col("i") * STEP, F.lit(BOTTOM) + F.col("j") * STEP
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    right = node.where(F.col("i") < n - 1).select((F.col("id") * 2).alias("k"), F.array(point(x, y), point(x + STEP, y)).alias("points"))
    up = node.where(F.col("j") < n - 1).select((F.col("id") * 2 + 1).alias("k"), F.array(point(x, y), point(x, y + STEP)).alias("points"))
    apart = spark.range(1).select(F.lit(9999).cast("long").alias("k"), F.array(point(F.lit(LEFT - 5000.0), F.lit(BOTTOM)), point(F.lit(LEFT - 4900.0), F.lit(BOTTOM))).alias("points"))
    d = right.unionAll(up).unionAll(apart)
    way = F.when(F.col("k") % 5 == 0, "F").when(F.col("k") % 7 == 0, "T").otherwise("B")
    kind = F.element_at(F.array(*map(F.lit, ("primary", "residential", "service", "footway"))), (F.when(F.col("k") % 31 == 0, 3).otherwise(F.col("k") % 3) + 1).cast("int"))
    return d.select(F.lpad(F.col("k").cast("string"), 6, "0").alias("osm_id"), kind.alias("fclass"), way.alias("oneway"), "points")


LATTICE = f"""node AS (SELECT id, id % {STREETS} AS i, id // {STREETS} AS j FROM (SELECT unnest(range({STREETS * STREETS})) AS id)),
street0 AS (
  SELECT id * 2 AS k, {LEFT} + i * {STEP} AS x1, {BOTTOM} + j * {STEP} AS y1, {LEFT} + (i + 1) * {STEP} AS x2, {BOTTOM} + j * {STEP} AS y2 FROM node WHERE i < {STREETS - 1}
  UNION ALL SELECT id * 2 + 1, {LEFT} + i * {STEP}, {BOTTOM} + j * {STEP}, {LEFT} + i * {STEP}, {BOTTOM} + (j + 1) * {STEP} FROM node WHERE j < {STREETS - 1}
  UNION ALL SELECT 9999, {LEFT - 5000}, {BOTTOM}, {LEFT - 4900}, {BOTTOM}
),
street AS (SELECT row_number() OVER (ORDER BY k) - 1 AS road_idx, lpad(CAST(k AS VARCHAR), 6, '0') AS osm_id, k, x1, y1, x2, y2, CASE WHEN k % 5 = 0 THEN 'F' WHEN k % 7 = 0 THEN 'T' ELSE 'B' END AS oneway,
  CASE k % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' ELSE 'service' END AS fclass FROM street0 WHERE k % 31 <> 0)"""


def segments(spark) -> DataFrame:
    return N.split(N.drivable(lattice(spark)))


@query("G2_segments", f"WITH {LATTICE} SELECT road_idx, osm_id, fclass, oneway, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM street")
def road_segments(spark, sf_dir):
    return segments(spark).select("road_idx", "osm_id", "fclass", "oneway", "x1", "y1", "x2", "y2")


#: Every fourth street is there twice, the second time both ways and with an id behind all others.
DOUBLED = f"""{LATTICE},
twice AS (SELECT osm_id, x1, y1, x2, y2, oneway FROM street UNION ALL SELECT 'z' || osm_id, x1, y1, x2, y2, 'B' FROM street WHERE k % 4 = 0),
all_ AS (SELECT row_number() OVER (ORDER BY osm_id) - 1 AS road_idx, * FROM twice)"""


@query(
    "G5_directed_edges",
    f"""WITH {DOUBLED}, way AS (
  SELECT road_idx, CAST(CAST(round(x1 * 1000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(y1 * 1000) AS BIGINT) AS VARCHAR) AS u, CAST(CAST(round(x2 * 1000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(y2 * 1000) AS BIGINT) AS VARCHAR) AS v, oneway,
    sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS m FROM all_
), each AS (SELECT u AS a, v AS b, road_idx, CAST(m AS DOUBLE) AS length_m FROM way WHERE oneway <> 'T' UNION ALL SELECT v, u, road_idx, m FROM way WHERE oneway <> 'F')
SELECT a, b, min(road_idx) AS road_idx, min(length_m) AS length_m FROM each GROUP BY a, b""",
)
def directed_edges(spark, sf_dir):
    d = N.drivable(lattice(spark))
    again = d.where(F.col("osm_id").cast("int") % 4 == 0).withColumns({"osm_id": F.concat(F.lit("z"), F.col("osm_id")), "oneway": F.lit("B")})
    return N.edges(N.split(d.unionByName(again))).select("a", "b", "road_idx", "length_m")


@query("G4_largest_component", f"WITH {LATTICE} SELECT row_number() OVER (ORDER BY road_idx) - 1 AS road_idx, osm_id FROM street WHERE k <> 9999")
def largest_component(spark, sf_dir):
    return N.largest_component(segments(spark)).select("road_idx", "osm_id")


def matched(spark, sf_dir, tolerance: float) -> DataFrame:
    d = projected(spark, sf_dir).select("src_seq", "timestamp", "x", "y")
    return R.nearest_segment(d, segments(spark), tolerance, ["fclass"])


@query(
    "J8_road_class",
    f"""{XY}, {LATTICE},
pair AS (
  SELECT src_seq, timestamp, road_idx, fclass, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t, x, y, x1, y1, x2, y2 FROM xy, street
),
dist AS (SELECT *, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS d FROM pair),
best AS (SELECT src_seq, min(d) AS d, arg_min(fclass, d) AS fclass FROM dist WHERE d <= 30 GROUP BY src_seq)
SELECT x.src_seq, fclass AS road_type, round(d, 4) AS road_distance_m, CASE WHEN fclass IS NULL THEN 'unmatched' ELSE 'matched' END AS road_match_status,
  CASE WHEN (timestamp + 28800) % 86400 // 3600 IN (7, 8) THEN 'morning_peak' WHEN (timestamp + 28800) % 86400 // 3600 IN (17, 18) THEN 'evening_peak' ELSE 'off_peak' END AS time_period
FROM xy x LEFT JOIN best USING (src_seq)""",
)
def road_class(spark, sf_dir):
    d = matched(spark, sf_dir, 30.0)
    status = F.when(F.col("road_idx").isNull(), "unmatched").otherwise("matched")
    return d.select("src_seq", F.col("fclass").alias("road_type"), F.round("distance", 4).alias("road_distance_m"), status.alias("road_match_status"), peak_label(F.col("timestamp")).alias("time_period"))


@query(
    "A8_match_counts",
    f"""{XY}, {LATTICE},
pair AS (SELECT src_seq, fclass, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t, x, y, x1, y1, x2, y2 FROM xy, street),
dist AS (SELECT *, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS d FROM pair),
best AS (SELECT src_seq, arg_min(fclass, d) AS fclass FROM dist WHERE d <= 30 GROUP BY src_seq)
SELECT CASE WHEN fclass IS NULL THEN 'unmatched' ELSE 'matched' END AS road_match_status, fclass AS road_type, count(*) AS n FROM xy LEFT JOIN best USING (src_seq) GROUP BY ALL""",
)
def match_counts(spark, sf_dir):
    return road_class(spark, sf_dir).groupBy("road_match_status", "road_type").agg(F.count(F.lit(1)).alias("n"))


def ends(spark, sf_dir) -> DataFrame:
    """Trips with both ends in metres."""
    t = T.trips(numbered(spark, sf_dir)).select("route_id", "start_lon", "start_lat", "end_lon", "end_lat")
    return projection.with_utm(projection.with_utm(t, "start_lon", "start_lat", "sx", "sy"), "end_lon", "end_lat", "ex", "ey")


def snapped_ends(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    net = cut_lineage(N.largest_component(segments(spark)))
    return N.snapped(ends(spark, sf_dir), net), net


def routed(spark, sf_dir) -> DataFrame:
    t, net = snapped_ends(spark, sf_dir)
    return N.route(t, N.edges(net))


def nearest_sql(points: str, key: str, tolerance: float) -> str:
    """(key, road_idx, d, t in metres, ...) of the nearest street of the component, ties to the smaller road_idx."""
    return f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY d, road_idx) AS n FROM (
    SELECT {key}, road_idx, oneway, x1, y1, x2, y2, pos, sqrt(pow(x - (x1 + pos / m * (x2 - x1)), 2) + pow(y - (y1 + pos / m * (y2 - y1)), 2)) AS d, m FROM (
      SELECT *, m * least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (m * m), 0), 1) AS pos
      FROM (SELECT p.*, road_idx, oneway, x1, y1, x2, y2, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS m FROM ({points}) p, street WHERE k <> 9999)
    )
  ) WHERE d <= {tolerance}
) WHERE n = 1"""


#: All streets are as long as one another, so distances on the lattice are numbers of steps.
ROUTED = f"""{GATED.replace('WITH pings', 'WITH RECURSIVE pings', 1)}, {LATTICE},
ends AS (SELECT '20170301_' || trip_id AS route_id, {projection.sql_forward('olon', 'olat')[0]} AS sx, {projection.sql_forward('olon', 'olat')[1]} AS sy, {projection.sql_forward('dlon', 'dlat')[0]} AS ex, {projection.sql_forward('dlon', 'dlat')[1]} AS ey FROM numbered WHERE dts IS NOT NULL),
start_ AS ({nearest_sql('SELECT route_id, sx AS x, sy AS y FROM ends', 'route_id', 500)}),
stop_ AS ({nearest_sql('SELECT route_id, ex AS x, ey AS y FROM ends', 'route_id', 500)}),
link AS (
  SELECT CAST(x1 AS BIGINT) * 100000000 + CAST(y1 AS BIGINT) AS a, CAST(x2 AS BIGINT) * 100000000 + CAST(y2 AS BIGINT) AS b FROM street WHERE k <> 9999 AND oneway <> 'T'
  UNION ALL SELECT CAST(x2 AS BIGINT) * 100000000 + CAST(y2 AS BIGINT), CAST(x1 AS BIGINT) * 100000000 + CAST(y1 AS BIGINT) FROM street WHERE k <> 9999 AND oneway <> 'F'
),
walk(src, dst, hops) AS (SELECT DISTINCT a, a, 0 FROM (SELECT a FROM link UNION SELECT b FROM link) UNION SELECT src, b, hops + 1 FROM walk JOIN link ON dst = a WHERE hops < 45),
steps AS (SELECT src, dst, min(hops) AS hops FROM walk GROUP BY ALL),
leave AS (
  SELECT route_id, CAST(x1 AS BIGINT) * 100000000 + CAST(y1 AS BIGINT) AS node, pos AS m FROM start_ WHERE oneway IN ('B', 'T')
  UNION ALL SELECT route_id, CAST(x2 AS BIGINT) * 100000000 + CAST(y2 AS BIGINT), m - pos FROM start_ WHERE oneway IN ('B', 'F')
),
arrive AS (
  SELECT route_id, CAST(x1 AS BIGINT) * 100000000 + CAST(y1 AS BIGINT) AS node, pos AS m FROM stop_ WHERE oneway IN ('B', 'F')
  UNION ALL SELECT route_id, CAST(x2 AS BIGINT) * 100000000 + CAST(y2 AS BIGINT), m - pos FROM stop_ WHERE oneway IN ('B', 'T')
),
ways AS (
  SELECT l.route_id, l.m + {STEP} * hops + r.m AS dist_m, hops + CAST(l.m > 1e-9 AS INTEGER) + CAST(r.m > 1e-9 AS INTEGER) AS n_edges
  FROM leave l JOIN arrive r USING (route_id) JOIN steps ON src = l.node AND dst = r.node
  UNION ALL SELECT route_id, abs(b.pos - a.pos), 1 FROM start_ a JOIN stop_ b USING (route_id)
  WHERE a.road_idx = b.road_idx AND abs(b.pos - a.pos) > 1e-9 AND (a.oneway = 'B' OR (a.oneway = 'F') = (b.pos > a.pos))
),
best AS (SELECT route_id, min(dist_m) AS dist_m, arg_min(n_edges, dist_m) AS n_edges FROM ways GROUP BY route_id),
routed AS (
  SELECT e.route_id, CASE WHEN a.road_idx IS NULL OR b.road_idx IS NULL THEN 'snap_far' WHEN a.road_idx = b.road_idx AND abs(a.pos - b.pos) <= 1e-6 THEN 'zero_distance' WHEN w.route_id IS NULL THEN 'no_path' ELSE 'ok' END AS status, w.dist_m, w.n_edges
  FROM ends e LEFT JOIN start_ a USING (route_id) LEFT JOIN stop_ b USING (route_id) LEFT JOIN best w USING (route_id)
),
path AS (SELECT route_id, status, CASE WHEN status = 'ok' THEN dist_m END AS dist_m, CASE WHEN status = 'ok' THEN n_edges ELSE 0 END AS n_edges FROM routed)"""


@query("G9_shortest_paths", f"{ROUTED} SELECT route_id, round(dist_m, 4) AS dist_m, n_edges, status FROM path")
def shortest_paths(spark, sf_dir):
    return routed(spark, sf_dir).where("alt_rank = 1").select("route_id", F.round("dist_m", 4).alias("dist_m"), "n_edges", "status")


@query("G10_path_sets", None)
def path_sets(spark, sf_dir):
    return routed(spark, sf_dir).select("route_id", "alt_rank", F.round("dist_m", 6).alias("dist_m"), F.round("ratio", 6).alias("ratio"), "n_edges", "status", "alt_status")


@query("G12_statuses", f"{ROUTED} SELECT status, count(*) AS n FROM path GROUP BY status")
def statuses(spark, sf_dir):
    return routed(spark, sf_dir).where("alt_rank = 1").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("G14_path_faults", f"{ROUTED} SELECT route_id FROM path WHERE status = 'ok' AND CAST(substr(route_id, 10) AS BIGINT) % 5 < 3")
def path_faults(spark, sf_dir):
    """Faults are put into the paths of three trips of five: a rank that is left out, a first ratio, a line of one point."""
    kind = F.substring("route_id", 10, 20).cast("long") % 5
    d = routed(spark, sf_dir)
    d = d.withColumns({
        "alt_rank": F.when(kind == 0, F.col("alt_rank") + 1).otherwise(F.col("alt_rank")),
        "ratio": F.when(kind == 1, F.col("ratio") + 0.5).otherwise(F.col("ratio")),
        "points": F.when((kind == 2) & (F.col("alt_rank") == 1), F.slice("points", 1, 1)).otherwise(F.col("points")),
    })
    return N.path_faults(d)


def detoured(spark, sf_dir, threshold: float = 1.5) -> DataFrame:
    p = projection.with_utm(gated_points(spark, sf_dir)).withColumns({"longitude": F.col("x"), "latitude": F.col("y")})
    return R.detours(T.lines(p), routed(spark, sf_dir).where("alt_rank = 1"), threshold)


PX, PY = projection.sql_forward("longitude", "latitude")
DETOURED = f"""{ROUTED}{POINTS[len(GATED):]},
place AS (SELECT route_id, seq, {PX} AS x, {PY} AS y FROM points),
leg AS (SELECT route_id, sqrt(pow(x - lag(x) OVER r, 2) + pow(y - lag(y) OVER r, 2)) AS m FROM place WINDOW r AS (PARTITION BY route_id ORDER BY seq)),
actual AS (SELECT route_id, count(*) AS n, coalesce(sum(m), 0) AS m FROM leg GROUP BY route_id),
held AS (
  SELECT a.route_id, CASE WHEN n > 1 THEN m END AS actual_m, p.dist_m AS optimal_m,
    CASE WHEN n < 2 THEN 'invalid_geometry' WHEN m <= 0 THEN 'zero_actual_length' WHEN p.route_id IS NULL THEN 'unmatched_route' WHEN p.dist_m IS NULL OR p.dist_m <= 0 THEN 'nonpositive_optimal_length' ELSE 'ok' END AS comparison_status
  FROM actual a LEFT JOIN path p USING (route_id)
),
rated AS (SELECT *, CASE WHEN comparison_status = 'ok' THEN actual_m / optimal_m END AS ratio FROM held)"""


@query(
    "J4_detours",
    f"{DETOURED} SELECT route_id, round(actual_m, 4) AS actual_length_m, round(optimal_m, 4) AS optimal_length_m, round(ratio, 6) AS detour_ratio, CAST(ratio >= 1.5 AS INTEGER) AS detour, comparison_status FROM rated",
)
def detours(spark, sf_dir):
    return detoured(spark, sf_dir).select("route_id", F.round("actual_length_m", 4).alias("actual_length_m"), F.round("optimal_length_m", 4).alias("optimal_length_m"), F.round("detour_ratio", 6).alias("detour_ratio"), "detour", "comparison_status")


SUMMARY = "count(ratio) AS eligible, coalesce(CAST(count(*) FILTER (ratio >= {0}) AS BIGINT), 0) AS detours, round(count(*) FILTER (ratio >= {0}) / count(ratio), 9) AS detour_rate"


@query(
    "A10_detour_summary",
    f"""{DETOURED}, out_ AS (SELECT comparison_status AS s, count(*) AS n FROM rated WHERE comparison_status <> 'ok' GROUP BY ALL)
SELECT {SUMMARY.format(1.5)}, (SELECT '{{' || coalesce(string_agg('"' || s || '":' || n, ',' ORDER BY s), '') || '}}' FROM out_) AS excluded FROM rated""",
)
def detour_summary(spark, sf_dir):
    return R.detour_summary(detoured(spark, sf_dir)).withColumns({"excluded": F.to_json("excluded"), "detour_rate": F.round("detour_rate", 9)})


@query("A11_detour_rate", f"{DETOURED} SELECT {SUMMARY.format(1.0)} FROM rated")
def detour_rate(spark, sf_dir):
    """By the older threshold, any way longer than the shortest."""
    return R.detour_summary(detoured(spark, sf_dir, 1.0)).select("eligible", "detours", F.round("detour_rate", 9).alias("detour_rate"))


@query("F11_drivable", f"WITH {LATTICE} SELECT osm_id, oneway FROM street")
def drivable(spark, sf_dir):
    return N.drivable(lattice(spark)).select("osm_id", "oneway")


@query(
    "J9_snapped",
    f"""{XY}, {LATTICE},
pair AS (SELECT src_seq, road_idx, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t, x, y, x1, y1, x2, y2 FROM xy, street),
dist AS (SELECT src_seq, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS d FROM pair)
SELECT src_seq, round(min(d), 4) AS snap_m FROM dist WHERE d <= 500 GROUP BY src_seq""",
)
def snapped(spark, sf_dir):
    d = projected(spark, sf_dir).select("src_seq", "x", "y")
    return R.nearest_segment(d, segments(spark), 500.0, []).where("road_idx is not null").select("src_seq", F.round("distance", 4).alias("snap_m"))


@query(
    "G8_same_segment",
    f"""{ROUTED} SELECT route_id, a.road_idx, CASE WHEN abs(b.pos - a.pos) > 1e-9 AND (a.oneway = 'B' OR (a.oneway = 'F') = (b.pos > a.pos)) THEN round(abs(b.pos - a.pos), 4) END AS direct_m
FROM start_ a JOIN stop_ b USING (route_id) WHERE a.road_idx = b.road_idx""",
)
def same_segment(spark, sf_dir):
    """Trips whose ends lie on one segment, with the length of the way along it where that is legal."""
    t, _ = snapped_ends(spark, sf_dir)
    direct = N.direct_metres(F.col("s_snap"), F.col("e_snap"))
    return t.where("s_snap.road_idx = e_snap.road_idx").select("route_id", "s_snap.road_idx", F.round(direct, 4).alias("direct_m"))

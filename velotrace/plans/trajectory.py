"""Queries of the trajectory operators over pings made from events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import projection
from ..functions.hexgrid import SQRT3, circumradius
from ..functions.scalars import overlaps_daily, overlaps_hours, peak_label
from ..operators import trajectory as T
from ..sources.pings import FROM_EVENTS_SQL, from_events, ordered
from .registry import query

DAY = "2017-03-01"
#: Shorter than the defaults, as the pings of a vehicle are minutes apart.
REST = Settings(parking_min_sec=300)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.features(pings(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with congestion by reported speed."""
    return T.label_congestion(featured(spark, sf_dir), "speed_reported_kmh")


def hav(a: str, b: str, c: str, d: str) -> str:
    x = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"({2 * DEFAULT.earth_radius_m!r} * asin(sqrt(least(greatest({x}, 0.0), 1.0))))"


W = "WINDOW w AS (PARTITION BY taxi_id ORDER BY timestamp, src_seq)"
CTE = f"""
WITH pings AS ({FROM_EVENTS_SQL}),
dedup AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY taxi_id, timestamp ORDER BY src_seq) AS n FROM pings) WHERE n = 1),
step AS (
  SELECT *, timestamp - lag(timestamp) OVER w AS dt, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(direction) OVER w AS pdir, lag(occupied) OVER w AS pocc,
    lead(timestamp) OVER w - timestamp AS ndt, lead(latitude) OVER w AS nlat, lead(longitude) OVER w AS nlon
  FROM dedup {W}
),
far AS (
  SELECT *, coalesce(dt > 0 AND dt <= 1800, false) AS near, {hav('plat', 'plon', 'latitude', 'longitude')} AS a, {hav('latitude', 'longitude', 'nlat', 'nlon')} AS b, {hav('plat', 'plon', 'nlat', 'nlon')} AS c
  FROM step
),
features AS (
  SELECT group_id, taxi_id, timestamp, latitude, longitude, direction, occupied, positioning_valid, src_seq, day,
    CASE WHEN near THEN dt END AS dt_sec, CASE WHEN near THEN round(a / dt * 3.6, 2) END AS speed_gps_kmh, speed AS speed_reported_kmh,
    CASE WHEN near THEN round(abs(((direction - pdir + 180) % 360 + 360) % 360 - 180), 1) END AS heading_delta_deg,
    CAST(NOT near AS INTEGER) AS trip_break,
    CAST(NOT (longitude BETWEEN 73 AND 135 AND latitude BETWEEN 18 AND 53) AS INTEGER) AS bad_coord,
    CAST(NOT (timestamp >= 1488297600 AND timestamp < 1488384000) AS INTEGER) AS out_of_day,
    CASE WHEN near AND pocc = 0 AND occupied = 1 THEN 'pickup' WHEN near AND pocc = 1 AND occupied = 0 THEN 'dropoff' ELSE '' END AS event_type,
    CAST(coalesce(dt > 0 AND ndt > 0 AND (
      (a / nullif(dt, 0) * 3.6 > 80 AND b / nullif(ndt, 0) * 3.6 > 80 AND c / nullif(dt + ndt, 0) * 3.6 < 80) OR (a > 1000 AND b > 1000 AND c < 1000)
      OR (a > 0 AND b > 0 AND degrees(acos(least(greatest((a * a + b * b - c * c) / (2 * a * b), -1.0), 1.0))) < 30)), false) AS INTEGER) AS is_outlier_drift
  FROM far
)"""


def seg_cte(source: str, name: str) -> str:
    return f"""{name}_e AS (SELECT *, CAST(lag(timestamp) OVER w IS NULL OR trip_break = 1 OR timestamp - lag(timestamp) OVER w <= 0 OR timestamp - lag(timestamp) OVER w > 1800 AS INTEGER) AS edge FROM {source} {W}),
{name} AS (SELECT * EXCLUDE (edge), sum(edge) OVER (PARTITION BY taxi_id ORDER BY timestamp, src_seq ROWS UNBOUNDED PRECEDING) AS segment FROM {name}_e)"""


def run_cte(source: str, name: str, flag: str, within: str | None) -> str:
    inside = f" OR {within} IS DISTINCT FROM lag({within}) OVER w" if within else ""
    return f"""{name}_f AS (SELECT *, coalesce({flag}, false) AS flag FROM {source}),
{name}_e AS (SELECT *, CAST(NOT flag OR NOT coalesce(lag(flag) OVER w, false){inside} AS INTEGER) AS edge FROM {name}_f {W}),
{name} AS (SELECT * EXCLUDE (edge), sum(edge) OVER (PARTITION BY taxi_id ORDER BY timestamp, src_seq ROWS UNBOUNDED PRECEDING) AS run FROM {name}_e)"""


CONGESTED = f"""{CTE}, {seg_cte('features', 'seg')}, {run_cte('seg', 'low', 'speed_reported_kmh < 20 AND bad_coord = 0', 'segment')},
labelled AS (
  SELECT *, CAST(flag AND max(timestamp) OVER (PARTITION BY taxi_id, run) - min(timestamp) OVER (PARTITION BY taxi_id, run) >= 240 AS INTEGER) AS congestion FROM low
)"""
GATED = f"""{CONGESTED},
block AS (SELECT *, sum(trip_break) OVER (PARTITION BY taxi_id ORDER BY timestamp, src_seq ROWS UNBOUNDED PRECEDING) AS block FROM labelled),
flip AS (
  SELECT *, CAST(coalesce(lag(occupied) OVER b <> occupied, true) AS INTEGER) AS new, coalesce(lag(occupied) OVER b = 0 AND lag(congestion) OVER b = 1 AND occupied = 1, false) AS gate
  FROM block WINDOW b AS (PARTITION BY taxi_id, block ORDER BY timestamp, src_seq)
),
island AS (SELECT *, sum(new) OVER (PARTITION BY taxi_id, block ORDER BY timestamp, src_seq ROWS UNBOUNDED PRECEDING) AS island FROM flip),
grouped AS (
  SELECT taxi_id, block, island, min(timestamp) AS ots, arg_min(longitude, timestamp) AS olon, arg_min(latitude, timestamp) AS olat, bool_or(gate) AS gate, count(*) AS n FROM island GROUP BY ALL
),
ended AS (
  SELECT *, lead(ots) OVER b AS dts, lead(olon) OVER b AS dlon, lead(olat) OVER b AS dlat FROM grouped WINDOW b AS (PARTITION BY taxi_id, block ORDER BY island)
),
numbered AS (SELECT *, row_number() OVER (ORDER BY taxi_id, ots) AS trip_id FROM ended WHERE gate)"""


@query("W1_first_per_second", f"{CTE} SELECT taxi_id, timestamp, src_seq FROM dedup")
def first_per_second(spark, sf_dir):
    return T.first_per_second(pings(spark, sf_dir)).select("taxi_id", "timestamp", "src_seq")


@query("S5_ordered_scan", f"WITH pings AS ({FROM_EVENTS_SQL}) SELECT * FROM pings")
def ordered_scan(spark, sf_dir):
    return ordered(pings(spark, sf_dir))


@query("W2_features", f"{CTE} SELECT * FROM features")
def features(spark, sf_dir):
    return featured(spark, sf_dir).drop("speed")


@query("W3_events", f"{CTE} SELECT event_type, occupied, count(*) AS n FROM features WHERE event_type <> '' GROUP BY ALL")
def ride_events(spark, sf_dir):
    return featured(spark, sf_dir).where("event_type <> ''").groupBy("event_type", "occupied").agg(F.count(F.lit(1)).alias("n"))


@query("W4_drift", f"{CTE} SELECT taxi_id, timestamp, is_outlier_drift FROM features WHERE is_outlier_drift = 1")
def drift(spark, sf_dir):
    return featured(spark, sf_dir).where("is_outlier_drift = 1").select("taxi_id", "timestamp", "is_outlier_drift")


@query("W5_segments", f"{CTE}, {seg_cte('features', 'seg')} SELECT taxi_id, timestamp, CAST(segment AS BIGINT) AS segment FROM seg")
def segments(spark, sf_dir):
    return T.segments(featured(spark, sf_dir)).select("taxi_id", "timestamp", "segment")


@query("W6_break_segments", f"{CTE} SELECT taxi_id, timestamp, CAST(sum(trip_break) OVER (PARTITION BY taxi_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment FROM features")
def break_segments(spark, sf_dir):
    return T.break_segments(featured(spark, sf_dir)).select("taxi_id", "timestamp", "segment")


SLOW = "CASE WHEN direction >= 180 THEN speed_reported_kmh ELSE 0 END"
SLOWED = f"{CTE}, slowed AS (SELECT *, {SLOW} AS slow FROM features)"


def parked_sql(variant: str) -> str:
    until = "CASE WHEN lead(segment) OVER w = segment THEN lead(timestamp) OVER w ELSE timestamp END" if variant == "canonical" else "coalesce(lead(timestamp) OVER w, timestamp)"
    breaks = "greatest(trip_break, CAST(coalesce(lag(gone) OVER w, true) AS INTEGER))" if variant == "canonical" else "trip_break"
    return f"""{SLOWED}, {seg_cte('slowed', 'seg')}, {run_cte('seg', 'rest', 'slow = 0', 'segment' if variant == 'canonical' else None)},
ends AS (SELECT *, {until} AS until FROM rest {W}),
mark AS (SELECT *, flag AND max(until) OVER (PARTITION BY taxi_id, run) - min(timestamp) OVER (PARTITION BY taxi_id, run) >= 300 AS gone FROM ends),
fresh AS (SELECT *, {breaks} AS brk FROM mark {W}),
kept AS (SELECT * REPLACE (brk AS trip_break) FROM fresh WHERE NOT gone)"""


def slowed(spark, sf_dir) -> DataFrame:
    return featured(spark, sf_dir).withColumn("slow", F.when(F.col("direction") >= 180, F.col("speed_reported_kmh")).otherwise(0.0))


@query("W7_drop_parking", f"{parked_sql('canonical')} SELECT taxi_id, timestamp, trip_break FROM kept")
def drop_parking(spark, sf_dir):
    return T.drop_parking(slowed(spark, sf_dir), "slow", REST).select("taxi_id", "timestamp", "trip_break")


@query("W8_drop_parking_script", f"{parked_sql('script')} SELECT taxi_id, timestamp, trip_break FROM kept")
def drop_parking_script(spark, sf_dir):
    return T.drop_parking(slowed(spark, sf_dir), "slow", REST, "script").select("taxi_id", "timestamp", "trip_break")


@query("W9_congestion", f"{CONGESTED} SELECT taxi_id, timestamp, congestion FROM labelled")
def congestion(spark, sf_dir):
    return labelled(spark, sf_dir).select("taxi_id", "timestamp", "congestion")


@query(
    "W10_congestion_script",
    f"""{CTE}, {run_cte('features', 'low', 'speed_reported_kmh < 20', None)}
SELECT taxi_id, timestamp, CAST(flag AND max(timestamp) OVER (PARTITION BY taxi_id, run) - min(timestamp) OVER (PARTITION BY taxi_id, run) >= 240 AS INTEGER) AS congestion FROM low""",
)
def congestion_script(spark, sf_dir):
    return T.label_congestion(featured(spark, sf_dir), "speed_reported_kmh", variant="script").select("taxi_id", "timestamp", "congestion")


@query(
    "W11_events_again",
    f"""{parked_sql('canonical')}
SELECT taxi_id, timestamp, CASE WHEN trip_break = 0 AND lag(occupied) OVER w = 0 AND occupied = 1 THEN 'pickup' WHEN trip_break = 0 AND lag(occupied) OVER w = 1 AND occupied = 0 THEN 'dropoff' ELSE '' END AS event_type
FROM kept {W}""",
)
def events_again(spark, sf_dir):
    return T.events_again(T.drop_parking(slowed(spark, sf_dir), "slow", REST)).select("taxi_id", "timestamp", "event_type")


def hex_sql(lon: str, lat: str, size: float = 300.0) -> tuple[str, str, str]:
    """CTE columns of a point's hexagon: qf, rf as a first step, then q and r of them."""
    x, y = projection.sql_forward(lon, lat)
    c = circumradius(size)
    first = f"(({x}) * {SQRT3 / 3!r} - ({y}) / 3) / {c!r} AS qf, (({y}) * {2 / 3!r}) / {c!r} AS rf"
    fix_q = "abs(round_even(qf, 0) - qf) > abs(round_even(-qf - rf, 0) - (-qf - rf)) AND abs(round_even(qf, 0) - qf) > abs(round_even(rf, 0) - rf)"
    q = f"CAST(CASE WHEN {fix_q} THEN -round_even(-qf - rf, 0) - round_even(rf, 0) ELSE round_even(qf, 0) END AS BIGINT)"
    r = f"CAST(CASE WHEN ({fix_q}) OR abs(round_even(-qf - rf, 0) - (-qf - rf)) > abs(round_even(rf, 0) - rf) THEN round_even(rf, 0) ELSE -round_even(qf, 0) - round_even(-qf - rf, 0) END AS BIGINT)"
    return first, q, r


FIRST, Q, R = hex_sql("longitude", "latitude")
HEXED = f"frac AS (SELECT *, {FIRST} FROM features), hexed AS (SELECT *, {Q} AS q, {R} AS r FROM frac)"


@query(
    "W12_congestion_events",
    f"""{CTE}, {HEXED}, {run_cte('hexed', 'slow', 'trip_break = 0 AND bad_coord = 0 AND speed_reported_kmh < 32', None)},
place AS (SELECT *, row_number() OVER (PARTITION BY taxi_id, run ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY taxi_id, run) AS n FROM slow WHERE flag),
g AS (
  SELECT taxi_id, run, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n, avg(speed_reported_kmh) AS speed, arg_min(latitude, timestamp) AS start_lat, arg_min(longitude, timestamp) AS start_lon,
    arg_max(latitude, timestamp) AS end_lat, arg_max(longitude, timestamp) AS end_lon, max(q) FILTER (i = n // 2) AS hex_q, max(r) FILTER (i = n // 2) AS hex_r
  FROM place GROUP BY ALL
)
SELECT taxi_id, start_ts, end_ts, end_ts - start_ts AS duration_sec, round(speed, 6) AS avg_speed_kmh,
  CASE WHEN speed > 30 THEN '畅通' WHEN speed > 20 THEN '轻度拥挤' WHEN speed > 10 THEN '拥挤' ELSE '严重拥挤' END AS congestion_level,
  start_lat, start_lon, end_lat, end_lon, hex_q, hex_r, CAST(end_ts - start_ts > 1800 AS INTEGER) AS likely_parked
FROM g WHERE n >= 2 AND end_ts - start_ts >= 180""",
)
def congestion_events(spark, sf_dir):
    return T.congestion_events(featured(spark, sf_dir), "speed_reported_kmh", digits=6)


@query(
    "W13_rides",
    f"""{CTE}, {HEXED},
cut AS (SELECT *, sum(CASE WHEN trip_break = 1 OR bad_coord = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY taxi_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS stretch, last_value(group_id) OVER (PARTITION BY taxi_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS gid FROM hexed),
inner_ AS (
  SELECT *, CAST(coalesce(lag(occupied) OVER s <> occupied, true) AS INTEGER) AS new, coalesce({hav('lag(latitude) OVER s', 'lag(longitude) OVER s', 'latitude', 'longitude')}, 0) AS step
  FROM cut WHERE NOT (trip_break = 1 OR bad_coord = 1) WINDOW s AS (PARTITION BY taxi_id, stretch ORDER BY timestamp)
),
walked AS (SELECT *, sum(new) OVER s AS island, sum(step) OVER s AS walked FROM inner_ WINDOW s AS (PARTITION BY taxi_id, stretch ORDER BY timestamp ROWS UNBOUNDED PRECEDING)),
first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY taxi_id, stretch, island ORDER BY timestamp) AS k FROM walked) WHERE k = 1),
phase AS (
  SELECT *, lead(timestamp) OVER s AS ets, lead(latitude) OVER s AS elat, lead(longitude) OVER s AS elon, lead(walked) OVER s AS ewalked, lead(q) OVER s AS eq, lead(r) OVER s AS er
  FROM first_ WINDOW s AS (PARTITION BY taxi_id, stretch ORDER BY island)
),
done AS (SELECT *, ewalked - walked AS m, ets - timestamp AS sec, CASE WHEN ets > timestamp THEN round((ewalked - walked) / (ets - timestamp) * 3.6, 2) END AS kmh FROM phase WHERE ets IS NOT NULL AND (occupied = 0 OR island > 1 OR event_type = 'pickup'))
SELECT CASE WHEN occupied = 1 THEN 'trip' ELSE 'idle' END AS kind, taxi_id, gid AS group_id, timestamp AS start_ts, latitude AS start_lat, longitude AS start_lon, ets AS end_ts, elat AS end_lat, elon AS end_lon,
  sec AS duration_sec, round(m, 1) AS path_distance_m, round({hav('latitude', 'longitude', 'elat', 'elon')}, 1) AS straight_distance_m, kmh AS avg_speed_kmh,
  q AS start_hex_q, r AS start_hex_r, eq AS end_hex_q, er AS end_hex_r, CASE WHEN occupied = 1 THEN sec BETWEEN 30 AND 7200 AND (kmh IS NULL OR kmh <= 120) END AS is_plausible
FROM done""",
)
def rides(spark, sf_dir):
    return T.rides(featured(spark, sf_dir))


def numbered(spark, sf_dir) -> DataFrame:
    return T.numbered(T.gated_runs(labelled(spark, sf_dir)), DAY)


@query(
    "W14_gated_trips",
    f"""{GATED}
SELECT '20170301_' || trip_id AS route_id, '{DAY}' AS trip_date, trip_id, taxi_id, ots AS start_time, olon AS start_lon, olat AS start_lat, dts AS end_time, dlon AS end_lon, dlat AS end_lat,
  CAST(dts - ots AS DOUBLE) AS duration_sec, round({hav('olat', 'olon', 'dlat', 'dlon')} / 1000, 6) AS straight_line_km, CAST(n + 1 AS INTEGER) AS n_points,
  dts - ots > 0 AND dts - ots <= 86400 AND {hav('olat', 'olon', 'dlat', 'dlon')} / 1000 <= (dts - ots) / 3600.0 * 150 AS is_plausible
FROM numbered WHERE dts IS NOT NULL""",
)
def gated_trips(spark, sf_dir):
    return T.trips(numbered(spark, sf_dir))


@query(
    "W14_incomplete",
    f"""{GATED}
SELECT '20170301_' || trip_id AS route_id, '{DAY}' AS trip_date, trip_id, taxi_id, ots AS start_time, olon AS start_lon, olat AS start_lat, 'no_observed_dropoff_before_break_or_vehicle_end' AS reason
FROM numbered WHERE dts IS NULL""",
)
def incomplete(spark, sf_dir):
    return T.incomplete(numbered(spark, sf_dir))


@query(
    "W15_gated_trips_script",
    GATED.replace("sum(trip_break) OVER (PARTITION BY taxi_id ORDER BY timestamp, src_seq ROWS UNBOUNDED PRECEDING) AS block FROM labelled", "0 AS block FROM labelled")
    + " SELECT row_number() OVER (ORDER BY taxi_id, ots) AS trip_id, taxi_id, ots AS start_time, dts AS end_time FROM numbered WHERE dts IS NOT NULL",
)
def gated_trips_script(spark, sf_dir):
    d = T.numbered(T.gated_runs(labelled(spark, sf_dir), "script"), DAY, complete_only=True)
    return d.select("trip_id", "taxi_id", F.col("o.timestamp").alias("start_time"), F.col("d.timestamp").alias("end_time"))


@query("W16_trip_numbers", f"{GATED} SELECT taxi_id, ots AS start_time, trip_id, '20170301_' || trip_id AS route_id FROM numbered")
def trip_numbers(spark, sf_dir):
    return numbered(spark, sf_dir).select("taxi_id", F.col("o.timestamp").alias("start_time"), "trip_id", "route_id")


POINTS = f"""{GATED},
points AS (
  SELECT '20170301_' || trip_id AS route_id, '{DAY}' AS trip_date, trip_id, l.taxi_id, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY timestamp) - 1 AS INTEGER) AS seq,
    CAST(timestamp = ots OR timestamp = dts AS INTEGER) AS is_endpoint, timestamp, longitude, latitude, occupied, congestion
  FROM labelled l JOIN numbered n ON l.taxi_id = n.taxi_id AND timestamp BETWEEN ots AND dts
)"""


def gated_points(spark, sf_dir) -> DataFrame:
    d = labelled(spark, sf_dir)
    return T.trip_points(d, T.numbered(T.gated_runs(d), DAY))


@query("W17_trip_points", f"{POINTS} SELECT * FROM points")
def trip_points(spark, sf_dir):
    return gated_points(spark, sf_dir)


@query(
    "W18_source_gaps",
    f"""{CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY taxi_id ORDER BY timestamp) AS i FROM features), k AS (SELECT * FROM n WHERE src_seq % 7 <> 0)
SELECT taxi_id, timestamp, greatest(trip_break, CAST(coalesce(i - lag(i) OVER w <> 1, true) AS INTEGER)) AS trip_break FROM k {W}""",
)
def source_gaps(spark, sf_dir):
    return T.source_gaps(featured(spark, sf_dir), F.col("src_seq") % 7 != 0).select("taxi_id", "timestamp", "trip_break")


@query(
    "F9_drop_bad_coord",
    f"""{CTE}, bad AS (SELECT * REPLACE (CAST(src_seq % 11 = 0 AS INTEGER) AS bad_coord) FROM features),
f AS (SELECT taxi_id, timestamp, bad_coord, greatest(trip_break, CAST(coalesce(lag(bad_coord) OVER w, 1) <> 0 AS INTEGER)) AS trip_break FROM bad {W})
SELECT taxi_id, timestamp, trip_break FROM f WHERE bad_coord = 0""",
)
def drop_bad_coord(spark, sf_dir):
    d = featured(spark, sf_dir).withColumn("bad_coord", (F.col("src_seq") % 11 == 0).cast("int"))
    return T.drop_bad_coord(d).select("taxi_id", "timestamp", "trip_break")


@query(
    "A14_trip_lines",
    f"{POINTS} SELECT route_id, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(timestamp AS VARCHAR), ',' ORDER BY seq) AS path FROM points GROUP BY route_id",
)
def trip_lines(spark, sf_dir):
    d = gated_points(spark, sf_dir).withColumns({"longitude": F.col("timestamp"), "latitude": F.col("timestamp")})
    return T.lines(d).select("route_id", F.size("points").alias("n"), F.array_join(F.transform("points", lambda p: p["x"].cast("string")), ",").alias("path"))


@query("A13_metrics", f"{parked_sql('canonical')} SELECT (SELECT count(*) FROM features) AS rows_input, count(*) AS rows_output, (SELECT count(*) FROM features) - count(*) AS rows_removed FROM kept")
def stage_metrics(spark, sf_dir):
    d = slowed(spark, sf_dir)
    return T.metrics(d, T.drop_parking(d, "slow", REST))


@query(
    "X6_peak_labels",
    f"{CTE} SELECT CASE WHEN h >= 7 AND h < 9 THEN 'morning_peak' WHEN h >= 17 AND h < 19 THEN 'evening_peak' ELSE 'off_peak' END AS label, count(*) AS n FROM (SELECT (timestamp + 28800) % 86400 // 3600 AS h FROM features) GROUP BY ALL",
)
def peak_labels(spark, sf_dir):
    return featured(spark, sf_dir).groupBy(peak_label(F.col("timestamp")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "X8_morning_trips",
    f"{GATED} SELECT trip_id, ots < 1488326400 AND dts > 1488322800 - 3600 + 0 AS in_window FROM numbered WHERE dts IS NOT NULL AND dts > ots",
)
def morning_trips(spark, sf_dir):
    t = T.trips(numbered(spark, sf_dir)).where("end_time > start_time")
    return t.select("trip_id", overlaps_daily(F.col("start_time"), F.col("end_time"), 6 * 60, 8 * 60).alias("in_window"))


@query(
    "X9_morning_hours",
    f"{GATED} SELECT trip_id, (ots + 28800) % 86400 // 3600 < 9 AND (dts + 28800) % 86400 // 3600 >= 7 AS in_hours FROM numbered WHERE dts IS NOT NULL",
)
def morning_hours(spark, sf_dir):
    t = T.trips(numbered(spark, sf_dir))
    return t.select("trip_id", overlaps_hours(F.col("start_time"), F.col("end_time")).alias("in_hours"))

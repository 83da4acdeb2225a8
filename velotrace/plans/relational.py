"""Queries of filters, scalars, joins and set operations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import relational as R
from ..operators import trajectory as T
from ..sources import pings as P
from ..sources.geometry import wkt_points
from ..sources.sinks import geojson_features, wkt_line
from .registry import query
from .trajectory import CTE, GATED, POINTS, featured, gated_points, hav, numbered, table


def _filter(name: str, condition: str) -> None:
    @query(name, f"{CTE} SELECT taxi_id, timestamp, src_seq FROM features WHERE {condition}")
    def filtered(spark, sf_dir):
        return featured(spark, sf_dir).where(condition).select("taxi_id", "timestamp", "src_seq")


for _name, _condition in {
    "F4_occupied": "occupied = 1",
    "F4_empty": "occupied = 0",
    "F6_low_speed": "trip_break = 0 AND dt_sec >= 8 AND speed_gps_kmh >= 0 AND speed_gps_kmh < 10",
    "F7_turns": "trip_break = 0 AND dt_sec >= 8 AND speed_gps_kmh >= 5 AND heading_delta_deg >= 45",
    "F8_pickups": "event_type = 'pickup'",
    "F8_dropoffs": "event_type = 'dropoff'",
}.items():
    _filter(_name, _condition)

RAW = "concat_ws(chr(9), CAST(user_id % 7 AS VARCHAR), CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), CAST(value AS VARCHAR), CASE WHEN event_id % 13 = 0 THEN '39.9x' ELSE CAST(3990000 + event_id % 999 AS VARCHAR) END, CAST(11640000 + event_id % 777 AS VARCHAR), '90', '', '', '', '', '', CASE WHEN event_id % 2 = 0 THEN '定位有效 重车' ELSE '空车' END)"


def raw(spark, sf_dir) -> DataFrame:
    lat = F.when(F.col("event_id") % 13 == 0, "39.9x").otherwise((F.lit(3990000) + F.col("event_id") % 999).cast("string"))
    state = F.when(F.col("event_id") % 2 == 0, "定位有效 重车").otherwise("空车")
    text = F.concat_ws("\t", (F.col("user_id") % 7).cast("string"), F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("value").cast("string"), lat, (F.lit(11640000) + F.col("event_id") % 777).cast("string"), F.lit("90"), *[F.lit("")] * 5, state)
    return table(spark, sf_dir, "events").select(text.alias("value"))


@query(
    "S2_raw_lines",
    """SELECT CAST(user_id % 7 AS VARCHAR) AS group_id, CAST(user_id AS VARCHAR) AS taxi_id, event_id AS timestamp, (3990000 + event_id % 999) / CAST(100000 AS DOUBLE) AS latitude, (11640000 + event_id % 777) / CAST(100000 AS DOUBLE) AS longitude,
  CAST(90 AS DOUBLE) AS direction, CAST(event_id % 2 = 0 AS INTEGER) AS positioning_valid, CAST(event_id % 2 = 0 AS INTEGER) AS occupied FROM events WHERE event_id % 13 <> 0""",
)
def raw_lines(spark, sf_dir):
    return P.raw_lines(raw(spark, sf_dir)).where("ok").drop("ok", "speed")


@query("S1_raw_counts", "SELECT event_id % 13 <> 0 AS ok, count(*) AS n FROM events GROUP BY ALL")
def raw_counts(spark, sf_dir):
    return P.raw_lines(raw(spark, sf_dir)).groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


@query("F1_bad_coord", "SELECT event_id, CAST(NOT (event_id % 70 + 70 BETWEEN 73 AND 135 AND event_id % 40 + 16 BETWEEN 18 AND 53) AS INTEGER) AS bad FROM events")
def bad_coord(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", scalars.bad_coord(e % 70 + 70, e % 40 + 16).alias("bad"))


@query("F2_out_of_day", f"{CTE} SELECT src_seq, CAST(NOT (timestamp >= 1488326400 AND timestamp < 1488412800) AS INTEGER) AS out_of_day FROM features")
def out_of_day(spark, sf_dir):
    return featured(spark, sf_dir).select("src_seq", scalars.out_of_day(F.col("timestamp"), 1488326400).alias("out_of_day"))


@query("F5_density_windows", f"{CTE} SELECT CASE WHEN h >= 7 AND h < 9 THEN 'morning' WHEN h >= 9 AND h < 17 THEN 'off_peak' WHEN h >= 17 AND h < 19 THEN 'evening' WHEN h < 6 THEN 'night' END AS w, count(*) AS n FROM (SELECT (timestamp + 28800) % 86400 // 3600 AS h FROM features) GROUP BY ALL")
def density_windows(spark, sf_dir):
    return featured(spark, sf_dir).groupBy(scalars.density_window(F.col("timestamp")).alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F10_plausible_trips",
    f"{GATED} SELECT trip_id FROM numbered WHERE dts IS NOT NULL AND dts > ots AND dts - ots <= 86400 AND {hav('olat', 'olon', 'dlat', 'dlon')} / 1000 <= (dts - ots) / 3600.0 * 150",
)
def plausible_trips(spark, sf_dir):
    t = T.trips(numbered(spark, sf_dir)).where(scalars.truthy(F.col("is_plausible"))).na.drop(subset=["start_lon", "start_lat", "end_lon", "end_lat", "route_id"])
    return t.withColumn("_n", F.row_number().over(Window.partitionBy("route_id").orderBy("trip_id"))).where("_n = 1").select("trip_id")


WORDS = "CASE event_id % 6 WHEN 0 THEN ' True ' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' WHEN 3 THEN '1' WHEN 4 THEN NULL ELSE 't' END"


@query(
    "X_scalars",
    f"""SELECT event_id, CAST(abs(((event_id % 360 - event_id * 7 % 360 + 180.0) % 360 + 360) % 360 - 180) AS DOUBLE) AS turn, CASE WHEN value > 30 THEN '畅通' WHEN value > 20 THEN '轻度拥挤' WHEN value > 10 THEN '拥挤' ELSE '严重拥挤' END AS level,
  coalesce(lower(trim({WORDS})) IN ('true', '1', 'yes', 'y', 't'), false) AS yes, CASE event_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'F' WHEN 2 THEN 'T' ELSE 'B' END AS way,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS number, CAST(value > 20 AS INTEGER) AS parked, '20170301_' || event_id AS route_id, CAST(event_id % 100 AS VARCHAR) || ':' || CAST(event_id % 7 * 1000 AS VARCHAR) AS node
FROM events""",
)
def scalar_functions(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    words = F.element_at(F.array(*[F.lit(w) for w in (" True ", "no", "Y", "1", None, "t")]), (e % 6 + 1).cast("int"))
    ways = F.element_at(F.array(*[F.lit(w) for w in ("none", "f ", "T", None)]), (e % 4 + 1).cast("int"))
    text = F.when(e % 3 == 0, F.concat(v.cast("string"), F.lit("f5"))).otherwise(v.cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(scalars.heading_delta((e * 7 % 360).cast("double"), (e % 360).cast("double")), 6).alias("turn"), scalars.congestion_level(v).alias("level"), scalars.truthy(words).alias("yes"),
        scalars.one_way(ways).alias("way"), scalars.parse_number(text).alias("number"), scalars.likely_parked(v, 20).alias("parked"), scalars.route_id(F.lit("2017-03-01"), e).alias("route_id"),
        scalars.node_key((e % 100) / 1000.0, (e % 7).cast("double")).alias("node"),
    )


@query(
    "X7_times",
    "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 1488319200 + event_id WHEN 1 THEN epoch_us(ts) // 1000000 ELSE epoch_us(ts) // 1000000 - 28800 END AS BIGINT) AS seconds FROM events",
)
def times(spark, sf_dir):
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, (F.lit(1488319200) + F.col("event_id")).cast("string")).when(kind == 1, F.concat(ts, F.lit("+00:00"))).otherwise(ts)
    return table(spark, sf_dir, "events").select("event_id", scalars.parse_time(text).alias("seconds"))


@query("X15_file_days", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '2017-03-0' || (event_id % 7 + 1) END AS day FROM events")
def file_days(spark, sf_dir):
    day = F.concat(F.lit("trip030"), (F.col("event_id") % 7 + 1).cast("string"), F.when(F.col("event_id") % 2 == 0, ".shp").otherwise("99.shp"))
    return table(spark, sf_dir, "events").select("event_id", scalars.day_of_file(day).alias("day"))


@query("A9_vehicles", f"{CTE} SELECT count(DISTINCT taxi_id) AS vehicles FROM features")
def vehicles(spark, sf_dir):
    return featured(spark, sf_dir).agg(F.count_distinct("taxi_id").alias("vehicles"))


@query("A15_first_per_key", "SELECT l_orderkey, l_suppkey AS first_supplier FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def first_per_key(spark, sf_dir):
    d = R.first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_suppkey"], ["l_suppkey"])
    return d.withColumnRenamed("l_suppkey", "first_supplier")


@query("A16_population", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY ALL")
def population(spark, sf_dir):
    return R.population(table(spark, sf_dir, "events"), ["event_type"], "value").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("J1_qualified_vehicles", f"{CTE} SELECT taxi_id, timestamp FROM features WHERE taxi_id IN (SELECT taxi_id FROM features WHERE occupied = 1 AND longitude BETWEEN 116.3995 AND 116.4005 AND latitude BETWEEN 39.8995 AND 39.9005)")
def qualified_vehicles(spark, sf_dir):
    inside = F.col("longitude").between(116.3995, 116.4005) & F.col("latitude").between(39.8995, 39.9005)
    return R.qualified(featured(spark, sf_dir), inside).select("taxi_id", "timestamp")


@query("J2_lines_with_trips", f"{POINTS} SELECT route_id, count(*) AS n, any_value(t.taxi_id) AS taxi_id, any_value(ots) AS start_time FROM points p LEFT JOIN (SELECT trip_id AS t_id, taxi_id, ots FROM numbered) t ON p.trip_id = t.t_id GROUP BY route_id")
def lines_with_trips(spark, sf_dir):
    lines = T.lines(gated_points(spark, sf_dir)).select("route_id", F.size("points").cast("long").alias("n"))
    trips = T.trips(numbered(spark, sf_dir)).select("route_id", "taxi_id", "start_time")
    return R.lines_with_trips(lines, trips, "route_id")


@query("J3_checked_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def checked_lookup(spark, sf_dir):
    lookup = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.with_lookup(table(spark, sf_dir, "orders"), lookup, "o_custkey").select("o_orderkey", "c_name")


@query("J6_cells", "SELECT event_id, CASE WHEN event_id % 10 < 3 AND user_id % 10 < 3 THEN 2 WHEN event_id % 10 < 5 AND user_id % 10 < 5 THEN 1 ELSE -1 END AS candidate_rank FROM events")
def regions_of_cells(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 10).alias("row"), (F.col("user_id") % 10).alias("col"))
    cell = spark.range(25).select((F.col("id") % 5).alias("row"), F.floor(F.col("id") / 5).alias("col"))
    cells = cell.withColumn("rank", F.lit(1)).unionAll(cell.where("row < 3 and col < 3").withColumn("rank", F.lit(2)))
    return R.in_cells(d, cells, ["event_id"])


@query(
    "J7_whole_segments",
    f"{CTE}, s AS (SELECT *, sum(trip_break) OVER (PARTITION BY taxi_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) - 1 AS segment FROM features) SELECT taxi_id, timestamp FROM (SELECT *, max(CAST(speed_reported_kmh > 200 AS INTEGER)) OVER (PARTITION BY taxi_id, segment) AS hit FROM s) WHERE hit = 1",
)
def whole_segments(spark, sf_dir):
    d = T.break_segments(featured(spark, sf_dir))
    return R.whole_segments(d, F.col("speed_reported_kmh") > 200, ["taxi_id", "segment"]).select("taxi_id", "timestamp")


@query("O2_stable_order", f"{CTE} SELECT taxi_id, timestamp, src_seq, row_number() OVER (ORDER BY taxi_id, timestamp, src_seq) AS place FROM features")
def stable_order(spark, sf_dir):
    return R.stable_order(featured(spark, sf_dir).select("taxi_id", "timestamp", "src_seq"), ["taxi_id", "timestamp", "src_seq"])


@query("O3_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def first_rows(spark, sf_dir):
    return R.head(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


@query("O4_strided", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 7 = 3")
def strided(spark, sf_dir):
    return R.strided(table(spark, sf_dir, "orders"), "o_orderkey", 7, 3).select("o_orderkey")


@query("O8_top_twenty", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def top_twenty(spark, sf_dir):
    return R.head(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), "user_id"], 20)


@query("U1_union_all", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return R.stacked(c, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")))


@query("U2_union_of_keys", "SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def union_of_keys(spark, sf_dir):
    return R.all_keys("k", table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")))


@query("U3_deduped", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def deduped(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], ["event_id", "value"])


@query("U4_repeated_keys", "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return R.more_than(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], 1)


@query("U4_unique_keys", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def unique_keys(spark, sf_dir):
    """Passes the assertion after duplicates have gone; the tests hold that it fails before."""
    return R.require_unique(deduped(spark, sf_dir).select("user_id", "event_type", "event_id"), ["user_id", "event_type"])


@query("A12_over_two", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 2")
def over_two(spark, sf_dir):
    return R.more_than(table(spark, sf_dir, "lineitem"), ["l_orderkey"], 2)


@query("A12_at_most", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n <= 2")
def at_most(spark, sf_dir):
    """Two paths a route at most: the assertion over the first two rows of each order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    two = table(spark, sf_dir, "lineitem").withColumn("_n", F.row_number().over(w)).where("_n <= 2").select("l_orderkey", "l_linenumber")
    return R.at_most(two, "l_orderkey")


@query(
    "U5_endpoints",
    f"""{GATED}, t AS (SELECT * FROM numbered WHERE dts IS NOT NULL)
SELECT '20170301_' || trip_id AS route_id, trip_id, taxi_id, 'O' AS point_type, ots AS timestamp, olon AS longitude, olat AS latitude FROM t
UNION ALL SELECT '20170301_' || trip_id, trip_id, taxi_id, 'D', dts, dlon, dlat FROM t""",
)
def endpoints(spark, sf_dir):
    return R.endpoints(T.trips(numbered(spark, sf_dir)))


@query(
    "SP25_line_lengths",
    f"""{POINTS}, leg AS (SELECT route_id, longitude * 1000 AS x, latitude * 1000 AS y, lag(longitude * 1000) OVER r AS px, lag(latitude * 1000) OVER r AS py FROM points WINDOW r AS (PARTITION BY route_id ORDER BY seq))
SELECT route_id, round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 6) AS length, CASE WHEN coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0) > 0 THEN 'ok' ELSE 'zero_length' END AS status FROM leg GROUP BY route_id""",
)
def line_lengths(spark, sf_dir):
    d = T.lines(gated_points(spark, sf_dir).withColumns({"longitude": F.col("longitude") * 1000, "latitude": F.col("latitude") * 1000}))
    return d.select("route_id", F.round(geometry.length(F.col("points")), 6).alias("length"), geometry.line_status(F.col("points")).alias("status"))


@query("S6_wkt", "SELECT event_id, 2 AS n, CAST(event_id % 10 AS DOUBLE) AS x, CAST(7 AS DOUBLE) AS y FROM events")
def wkt(spark, sf_dir):
    text = F.concat(F.lit("LINESTRING ("), (F.col("event_id") % 10).cast("string"), F.lit(" 7, 3.5 4)"))
    p = wkt_points(text)
    return table(spark, sf_dir, "events").select("event_id", F.size(p).alias("n"), F.element_at(p, 1)["x"].alias("x"), F.element_at(p, 1)["y"].alias("y"))


@query("S11_wkt_lines", f"{POINTS} SELECT route_id, 'LINESTRING (' || string_agg(seq || '.0 ' || timestamp || '.0', ', ' ORDER BY seq) || ')' AS wkt FROM points GROUP BY route_id")
def wkt_lines(spark, sf_dir):
    d = gated_points(spark, sf_dir).withColumns({"longitude": F.col("seq").cast("double"), "latitude": F.col("timestamp").cast("decimal(12,1)")})
    return T.lines(d).select("route_id", wkt_line(F.col("points")).alias("wkt"))


@query("S11_geojson", None)
def geojson(spark, sf_dir):
    return geojson_features(T.lines(gated_points(spark, sf_dir)), "points")



"""Queries of sources, sinks and stages: each writes into a new folder of the shared one and reads what came back."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import geometry, projection, scalars
from ..functions.sql import register
from ..operators import grids, network
from ..operators import relational as R
from ..operators import trajectory as T
from ..sources import geometry as G
from ..sources import pings as P
from ..sources import sinks as S
from ..tables import fresh_path
from . import stages
from .network import ROUTED, ends, lattice, snapped_ends
from .registry import query
from .spatial import CELL, GRID, INSIDE, XY, projected, ring
from .trajectory import CTE, GATED, HEXED, POINTS, featured, gated_points, hav, numbered, pings, table

CORE = [f.name for f in P.CORE.fields]


def text_pings(spark, sf_dir) -> DataFrame:
    """Pings as text, one time of eleven, one speed of seven, one direction of five and one latitude of thirteen not
    readable."""
    d = pings(spark, sf_dir)
    e = F.col("src_seq")
    spoil = lambda name, every, bad: F.when(e % every == 0, bad).otherwise(F.col(name).cast("string")).alias(name)
    spoilt = {"timestamp": spoil("timestamp", 11, "12x"), "speed": spoil("speed", 7, "fast"), "direction": spoil("direction", 5, "north"), "latitude": spoil("latitude", 13, "")}
    return d.select(*[spoilt.get(n, F.col(n).cast("string").alias(n)) for n in CORE])


READ = f"""WITH pings AS ({P.FROM_EVENTS_SQL})
SELECT group_id, taxi_id, timestamp, CASE WHEN src_seq % 7 = 0 THEN 'fast' ELSE 'read' END AS speed, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, CASE WHEN src_seq % 5 <> 0 THEN round(direction, 6) END AS direction, positioning_valid, occupied
FROM pings WHERE src_seq % 11 <> 0 AND src_seq % 13 <> 0"""


def rounded(d: DataFrame) -> DataFrame:
    speed = F.when(F.col("speed") == "fast", "fast").when(scalars.parse_number(F.col("speed")).isNotNull(), "read")
    return d.withColumns({"speed": speed, "latitude": F.round("latitude", 9), "longitude": F.round("longitude", 9), "direction": F.round("direction", 6)})


@query("S3_csv", READ)
def csv_by_name(spark, sf_dir):
    """Columns found by name, whatever their order; an extra one isn't read."""
    path = fresh_path(spark, "csv")
    S.write_csv(text_pings(spark, sf_dir).select(F.lit("x").alias("extra"), *reversed(CORE)), path)
    return rounded(P.read_csv(spark, path))


@query("S3_csv_counts", "SELECT count(*) AS n FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0")
def csv_counts(spark, sf_dir):
    """As many rows when nothing of them is selected."""
    path = fresh_path(spark, "csv")
    S.write_csv(text_pings(spark, sf_dir), path)
    return P.read_csv(spark, path).agg(F.count(F.lit(1)).alias("n"))


@query("S4_positional", f"SELECT * FROM ({READ}) WHERE CAST(taxi_id AS BIGINT) % 3 <> 0")
def positional(spark, sf_dir):
    """Every third vehicle's lines have a field too many, and are none."""
    path = fresh_path(spark, "lines")
    line = F.concat_ws(",", *CORE)
    text_pings(spark, sf_dir).select(F.when(F.col("taxi_id").cast("long") % 3 == 0, F.concat(line, F.lit(",x"))).otherwise(line).alias("value")).write.text(path)
    return rounded(P.read_positional(spark, path))


@query("S6_charsets", "SELECT event_id, '五环路' AS road, 2 AS n FROM events UNION ALL SELECT -event_id, '三环路', 2 FROM events")
def charsets(spark, sf_dir):
    """A layer in UTF-8 and one in GBK."""
    d = table(spark, sf_dir, "events").select("event_id")
    line = F.lit("LINESTRING (1 2, 3 4)")
    out = []
    # the second layer's bytes are written as the characters that stand for them
    for sign, road, charset in ((1, "五环路", "UTF-8"), (-1, "三环路".encode("gbk").decode("latin-1"), "ISO-8859-1")):
        path = fresh_path(spark, "layer")
        d.select((F.col("event_id") * sign).alias("event_id"), F.lit(road).alias("road"), line.alias("wkt")).write.option("header", True).option("encoding", charset).csv(path)
        out.append(G.read_wkt(spark, path).select(F.col("event_id").cast("long").alias("event_id"), "road", F.size("points").alias("n")))
    return R.stacked(*out)


@query("S7_days", "SELECT '2017030' || (event_id % 3 + 1) || '_' || event_id AS route_id, '2017-03-0' || (event_id % 3 + 1) AS trip_date, event_id AS trip_id FROM events")
def day_files(spark, sf_dir):
    root = fresh_path(spark, "days")
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("trip_id"))
    for i in range(3):
        d.where(F.col("trip_id") % 3 == i).write.parquet(f"{root}/trip030{i + 1}")
    return G.read_days(spark, f"{root}/trip*")


@query("S8_shards", "SELECT event_id FROM events")
def shard_files(spark, sf_dir):
    root = fresh_path(spark, "shards")
    d = table(spark, sf_dir, "events").select("event_id")
    for i in range(3):
        d.where(F.col("event_id") % 3 == i).write.parquet(f"{root}/shard_{i}/deep")
    return G.read_shards(spark, root)


HISTOGRAM = f"{XY} SELECT CAST(day % 7 AS INTEGER) AS label, {CELL}, CAST(count(*) AS DOUBLE) AS value FROM xy WHERE {INSIDE} GROUP BY ALL"


def stored_raster(spark, sf_dir) -> str:
    path = fresh_path(spark, "raster")
    S.write_raster(grids.histogram(projected(spark, sf_dir), GRID, None, ["label"]), asdict(GRID), path)
    return path


@query("S13_raster", HISTOGRAM)
def raster(spark, sf_dir):
    return S.read_raster(spark, stored_raster(spark, sf_dir), asdict(GRID)).select("label", "row", "col", "value")


def _outcome(spark, rows: list[tuple[str, object]]) -> DataFrame:
    """What became of each step: done, or the kind of error."""
    out = []
    for name, step in rows:
        try:
            step()
            out.append((name, "done"))
        except Exception as e:  # the outcome is what is asked for
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "step string, outcome string")


@query("S9_grids", "SELECT * FROM (VALUES ('same', 'done'), ('cell', 'ValueError'), ('crs', 'ValueError')) t(step, outcome)")
def grid_checks(spark, sf_dir):
    path, spec = stored_raster(spark, sf_dir), asdict(GRID)
    read = lambda **other: lambda: S.read_raster(spark, path, spec | other).count()
    return _outcome(spark, [("same", read()), ("cell", read(cell=100.0)), ("crs", read(crs="EPSG:4326"))])


@query("S10_csv", "SELECT o_orderkey, o_orderstatus, 1 AS marked, 1 AS refused FROM orders")
def csv_sink(spark, sf_dir):
    path = fresh_path(spark, "orders")
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    S.write_csv(d, path)
    again = _outcome(spark, [("again", lambda: S.write_csv(d, path))]).first().outcome != "done"
    # every file begins with the mark
    first = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).agg(F.min(F.expr("hex(substring(content, 1, 3)) = 'EFBBBF'")).alias("m")).first().m
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.lit(int(first)).alias("marked"), F.lit(int(again)).alias("refused"))


LINES = f"{POINTS} SELECT route_id, count(*) AS n, round(arg_min(longitude, seq), 9) AS x, round(arg_max(latitude, seq), 9) AS y FROM points GROUP BY route_id HAVING count(*) > 1"


def _vector(kind: str) -> None:
    @query(f"S11_{kind}", LINES)
    def vector(spark, sf_dir):
        """Written in two parts, the second appended, their rows counted."""
        path = fresh_path(spark, "lines") + f".{kind}"
        d = T.lines(gated_points(spark, sf_dir)).where("points is not null")
        even = F.substring("route_id", 10, 20).cast("long") % 2 == 0
        S.write_vector(d.where(even), "points", path)
        S.write_vector(d.where(~even), "points", path, append=True)
        if kind == "geojson":
            back = G.read_geojson(spark, path).select(F.col("properties")["route_id"].alias("route_id"), "points")
        else:
            back = G.read_wkt(spark, path) if kind == "csv" else spark.read.parquet(path)
        return back.select("route_id", F.size("points").cast("long").alias("n"), F.round(F.element_at("points", 1)["x"], 9).alias("x"), F.round(F.element_at("points", -1)["y"], 9).alias("y"))


for _kind in ("geojson", "csv", "parquet"):
    _vector(_kind)


@query("S12_parts", "SELECT count(*) AS n, true AS bounded, true AS split FROM lineitem")
def parts(spark, sf_dir):
    path = fresh_path(spark, "parts")
    S.write_parts(table(spark, sf_dir, "lineitem").select("l_orderkey"), path, 500)
    per = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n"), (F.max("n") <= 500).alias("bounded"), (F.count(F.lit(1)) > 1).alias("split"))


@query("S14_json", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def json_summary(spark, sf_dir):
    path = fresh_path(spark, "summary")
    S.write_json(spark, {r[0]: r[1] for r in table(spark, sf_dir, "events").groupBy("event_type").count().collect()}, path)
    return spark.createDataFrame(list(S.read_json(spark, path).items()), "event_type string, n long")


@query("S17_replaced", "SELECT event_id, 2 AS version FROM events WHERE event_id % 2 = 0")
def replaced(spark, sf_dir):
    """New data made of the old, put in their place."""
    path = fresh_path(spark, "replaced")
    S.replace(table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("version")), path)
    S.replace(spark.read.parquet(path).where("event_id % 2 = 0").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path)


DEDUP = f"SELECT *, row_number() OVER (PARTITION BY day % 2, taxi_id, timestamp ORDER BY src_seq) AS n FROM ({P.FROM_EVENTS_SQL})"
DAYS = {"2017-03-01": 0, "2017-03-02": 1}


def _days(spark, sf_dir) -> dict[str, DataFrame]:
    d = pings(spark, sf_dir)
    return {day: d.where(F.col("day") % 2 == i) for day, i in DAYS.items()}


@query(
    "R1_days",
    f"""WITH d AS ({DEDUP}), n AS (SELECT day % 2 AS i, count(*) AS n FROM d WHERE n = 1 GROUP BY ALL)
SELECT '2017-03-0' || (i + 1) || ' features' AS stage, run, CASE WHEN run = 1 THEN 'SUCCESS' ELSE 'SKIPPED' END AS status, CASE WHEN run = 1 THEN n END AS rows FROM n, (VALUES (1), (2)) r(run)""",
)
def days(spark, sf_dir):
    """Two days, run twice: the second time everything is there."""
    root = fresh_path(spark, "run")
    done = [(r.stage, run, r.status, r.metrics.get("rows")) for run in (1, 2) for r in stages.run_days(spark, _days(spark, sf_dir), root, stages=stages.STAGES[:1])]
    return spark.createDataFrame(done, "stage string, run int, status string, rows long")


@query("R3_results", "SELECT * FROM (VALUES ('good', 'SUCCESS', true), ('good', 'SKIPPED', true), ('bad', 'FAILED', false)) t(stage, status, fine)")
def results(spark, sf_dir):
    root, d = fresh_path(spark, "run"), pings(spark, sf_dir)
    run = lambda name, source: stages.run_stage(spark, name, stages.features, source, f"{root}/{name}", "2017-03-01")
    done = [run("good", d), run("good", d), run("bad", d.drop("speed"))]
    return spark.createDataFrame([(r.stage, r.status, r.error is None) for r in done], "stage string, status string, fine boolean")


@query("S18_marks", "SELECT * FROM (VALUES ('finished', true, true), ('half', false, false)) t(state, found, there)")
def marks(spark, sf_dir):
    """What was finished stays; what was left half done goes."""
    out = []
    for state, whole in (("finished", True), ("half", False)):
        path = fresh_path(spark, state)
        table(spark, sf_dir, "nation").write.parquet(path)
        at, fs = S._path(spark, path)
        if not whole:
            fs.delete(S._path(spark, f"{path}/_SUCCESS")[0], False)
        out.append((state, S.finished(spark, path), fs.exists(at)))
    return spark.createDataFrame(out, "state string, found boolean, there boolean")


@query("R4_run_folders", "SELECT * FROM (VALUES ('plan', 'done'), ('first', 'done'), ('second', 'FileExistsError')) t(step, outcome)")
def run_folders(spark, sf_dir):
    root = fresh_path(spark, "runs")
    run = lambda execute: lambda: S.new_run(spark, root, "one", execute)
    return _outcome(spark, [("plan", run(False)), ("first", run(True)), ("second", run(True))])


@query("R2_settings", "SELECT name, CAST(value AS DOUBLE) AS value FROM (VALUES ('max_gap_sec', 1800.0), ('parking_min_sec', 3600.0), ('congestion_speed_kmh', 20.0), ('congestion_min_sec', 240.0), ('event_speed_kmh', 32.0), ('event_min_sec', 180.0), ('hex_size_m', 300.0), ('kde_cell_m', 150.0), ('kde_radius_m', 800.0), ('hotspot_top_fraction', 0.03), ('alpha_z', 1.96), ('road_tolerance_m', 30.0), ('snap_tolerance_m', 500.0), ('alternative_ratio', 1.2), ('alternative_attempts', 5.0), ('random_seed', 42.0), ('detour_ratio', 1.5), ('refused', 5.0)) t(name, value)")
def settings(spark, sf_dir):
    """Defaults, and how many of five bad values are refused."""
    asked = ["max_gap_sec", "parking_min_sec", "congestion_speed_kmh", "congestion_min_sec", "event_speed_kmh", "event_min_sec", "hex_size_m", "kde_cell_m", "kde_radius_m", "hotspot_top_fraction", "alpha_z", "road_tolerance_m", "snap_tolerance_m", "alternative_ratio", "alternative_attempts", "random_seed", "detour_ratio"]
    refused = 0
    for bad in ({"max_gap_sec": 0}, {"hotspot_top_fraction": 1.0}, {"alternative_ratio": 0.9}, {"hex_size_m": -1.0}, {"detour_ratio": 0.0}):
        try:
            Settings(**bad)
        except ValueError:
            refused += 1
    return spark.createDataFrame([*((n, float(getattr(DEFAULT, n))) for n in asked), ("refused", float(refused))], "name string, value double")


@query("R6_whole_vehicles", f"WITH pings AS ({P.FROM_EVENTS_SQL}) SELECT taxi_id, 1 AS blocks, count(*) AS n FROM pings GROUP BY taxi_id")
def whole_vehicles(spark, sf_dir):
    """All rows of a vehicle are in one partition."""
    d = P.ordered(pings(spark, sf_dir), 7).withColumn("_p", F.spark_partition_id())
    return d.groupBy("taxi_id").agg(F.count_distinct("_p").cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))


@query("R8_empty", "SELECT * FROM (VALUES ('route_id', 'string'), ('trip_date', 'string'), ('trip_id', 'bigint'), ('taxi_id', 'string'), ('start_time', 'bigint'), ('start_lon', 'double'), ('start_lat', 'double'), ('end_time', 'bigint'), ('end_lon', 'double'), ('end_lat', 'double'), ('duration_sec', 'double'), ('straight_line_km', 'double'), ('n_points', 'int'), ('is_plausible', 'boolean')) t(name, kind)")
def empty(spark, sf_dir):
    """Trips of no pings keep their columns."""
    none = T.trips(numbered(spark, sf_dir).where("false"))
    path = fresh_path(spark, "empty")
    none.write.parquet(path)
    return spark.createDataFrame(spark.read.parquet(path).dtypes, "name string, kind string")


@query("X19_checks", "SELECT * FROM (VALUES ('there', 'done'), ('missing', 'ValueError'), ('crs', 'done'), ('other crs', 'ValueError'), ('no crs', 'ValueError')) t(step, outcome)")
def checks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return _outcome(spark, [
        ("there", lambda: R.require_columns(e, ["event_id", "ts"])), ("missing", lambda: R.require_columns(e, ["event_id", "speed"])), ("crs", lambda: R.require_crs("epsg:32650", GRID.crs)),
        ("other crs", lambda: R.require_crs("EPSG:4326", GRID.crs)), ("no crs", lambda: R.require_crs(None, GRID.crs)),
    ])


@query("X20_safe_values", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE CAST(value AS DOUBLE) END AS value FROM events")
def safe_values(spark, sf_dir):
    kind = F.col("event_id") % 3
    value = F.when(kind == 0, F.lit(None).cast("double")).when(kind == 1, F.lit(float("nan"))).otherwise(F.col("value").cast("double"))
    return table(spark, sf_dir, "events").select("event_id", scalars.no_nan(value).alias("value"))


@query(
    "SP10_kernel",
    """WITH o AS (SELECT a.i, b.i AS j FROM range(-3, 4) a(i), range(-3, 4) b(i)) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(pow(1 - (i * i + j * j) / 9.0, 2) * 3 / (pi() * 9), 9) AS w FROM o WHERE i * i + j * j < 9""",
)
def kernel(spark, sf_dir):
    """500 m in cells of 150: three whole cells."""
    return spark.createDataFrame([(i, j, round(w, 9)) for i, j, w in grids.kernel(500.0, 150.0, script=True)], "i int, j int, w double")


@query("SP28_merged_lines", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'LINESTRING (' || event_id % 5 || '.0 0.0, ' || event_id % 5 || '.0 1.0, 7.0 7.0' || CASE WHEN event_id % 4 = 1 THEN ', 8.0 8.0, 9.0 9.0' ELSE '' END || ')' END AS wkt FROM events")
def merged_lines(spark, sf_dir):
    """Parts that join, a null one, one without length, and one that begins elsewhere; or none at all."""
    e = F.col("event_id")
    line = lambda *p: F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in p])
    n = F.lit
    first, zero, second, apart = line((e % 5, n(0)), (e % 5, n(1))), line((n(3), n(3)), (n(3), n(3))), line((e % 5, n(1)), (n(7), n(7))), line((n(8), n(8)), (n(9), n(9)))
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    parts_ = F.when(e % 4 == 3, F.array(zero, none)).when(e % 4 == 1, F.array(first, none, second, apart)).otherwise(F.array(first, zero, second))
    return table(spark, sf_dir, "events").select("event_id", S.wkt_line(geometry.merge_lines(parts_)).alias("wkt"))


@query("G15_shards", f"{ROUTED} SELECT route_id, round(dist_m, 4) AS dist_m, n_edges, status FROM path")
def sharded_routes(spark, sf_dir):
    """Trips in three shards, each routed alone: together they are what they are at once."""
    trips, net = snapped_ends(spark, sf_dir)
    edges = network.edges(net)
    shard = lambda i: network.route(trips.where(F.substring("route_id", 10, 20).cast("long") % 3 == i), edges)
    return R.stacked(*map(shard, range(3))).where("alt_rank = 1").select("route_id", F.round("dist_m", 4).alias("dist_m"), "n_edges", "status")


@query(
    "R7_final_export",
    f"""{GATED} SELECT count(*) AS trips FROM numbered WHERE dts IS NOT NULL""",
)
def final_export(spark, sf_dir):
    """Path sets from files, those of the morning in an area, and their detours: as many trips as there are, since pings
    are of a morning and the area holds them all."""
    root = fresh_path(spark, "export")
    t = T.trips(numbered(spark, sf_dir)).select("route_id", "start_time", "end_time")
    t.join(ends(spark, sf_dir), "route_id").write.parquet(f"{root}/trips")
    lattice(spark).write.parquet(f"{root}/roads")
    p = projection.with_utm(gated_points(spark, sf_dir)).withColumns({"longitude": F.col("x"), "latitude": F.col("y")})
    T.lines(p).write.parquet(f"{root}/actual")
    area = spark.range(1).select(F.lit(0).alias("ord"), F.lit("all").alias("name"), ring([(440000, 4400000), (460000, 4400000), (460000, 4430000), (440000, 4430000)]).alias("points"))
    stages.solve_path_sets(spark, f"{root}/trips", f"{root}/roads", f"{root}/paths")
    stages.select_morning(spark, f"{root}/paths", f"{root}/trips", area, f"{root}/morning", hours=(0, 24), cell=5000.0)
    done = stages.final_export(spark, f"{root}/morning", f"{root}/actual", f"{root}/out")
    failed = [r.error for r in done if r.status == "FAILED"]
    if failed:
        raise RuntimeError(failed[0])
    return spark.read.parquet(f"{root}/out/detours").agg(F.count(F.lit(1)).alias("trips"))


@query(
    "U_sql_functions",
    f"""{XY}, d AS (SELECT src_seq, {hav('latitude', 'longitude', '39.9', '116.4')} AS m, x, y, longitude > 116.395 AND longitude < 116.405 AND latitude > 39.895 AND latitude < 39.905 AS inside FROM xy)
SELECT src_seq, round(m, 6) AS m, round(x, 4) AS x, round(y, 4) AS y, inside FROM d""",
)
def sql_functions(spark, sf_dir):
    register(spark)
    featured(spark, sf_dir).createOrReplaceTempView("velotrace_features")
    box = "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in ((116.395, 39.895), (116.405, 39.895), (116.405, 39.905), (116.395, 39.905))) + ")"
    return spark.sql(f"SELECT src_seq, round(haversine_m(latitude, longitude, 39.9D, 116.4D), 6) AS m, round(u.x, 4) AS x, round(u.y, 4) AS y, point_in_ring(longitude, latitude, {box}) AS inside FROM (SELECT *, utm50n(longitude, latitude) AS u FROM velotrace_features)")


@query("U_sql_hexagons", f"{CTE}, {HEXED} SELECT src_seq, q, r FROM hexed")
def sql_hexagons(spark, sf_dir):
    register(spark)
    featured(spark, sf_dir).createOrReplaceTempView("velotrace_features")
    return spark.sql("SELECT src_seq, h.q, h.r FROM (SELECT src_seq, hex_bin(u.x, u.y) AS h FROM (SELECT src_seq, utm50n(longitude, latitude) AS u FROM velotrace_features))")

"""Window operators over the pings of each vehicle.

All windows are led by taxi_id, so a chain of these operators costs one shuffle. Runs are gaps and islands: a running
count of boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import hexgrid, projection
from ..functions.scalars import bad_coord, congestion_level, haversine_m, heading_delta, likely_parked, out_of_day, plausible_ride, plausible_trip, route_id, speed_kmh


def by_time() -> WindowSpec:
    return Window.partitionBy("taxi_id").orderBy("timestamp", "src_seq")


def so_far_in_time() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)



def _running(flag: Column) -> Column:
    return F.sum(flag.cast("int")).over(so_far_in_time())


def first_per_second(df: DataFrame) -> DataFrame:
    """Of the rows of a vehicle and second, the one that came first."""
    again = F.coalesce(F.lag("timestamp").over(by_time()) == F.col("timestamp"), F.lit(False))
    return df.withColumn("_again", again).where("not _again").drop("_again")


def lag_features(df: DataFrame, c: Settings = DEFAULT) -> DataFrame:
    """dt_sec, speed_gps_kmh, heading_delta_deg, trip_break and event_type."""
    before = lambda x: F.lag(x).over(by_time())
    dt = F.col("timestamp") - before("timestamp")
    near = F.coalesce((dt > 0) & (dt <= c.max_gap_sec), F.lit(False))
    metres = haversine_m(before("latitude"), before("longitude"), F.col("latitude"), F.col("longitude"), c.earth_radius_m)
    was, now = before("occupied"), F.col("occupied")
    d = df.withColumns({"_near": near, "_dt": dt, "_m": metres, "_h": heading_delta(before("direction"), F.col("direction")), "_was": was})
    return d.withColumns(
        {
            "dt_sec": F.when(F.col("_near"), F.col("_dt")),
            "speed_gps_kmh": F.when(F.col("_near"), speed_kmh(F.col("_m"), F.col("_dt"))),
            "heading_delta_deg": F.when(F.col("_near"), F.round("_h", 1)),
            "trip_break": (~F.col("_near")).cast("int"),
            "event_type": F.when(F.col("_near") & (F.col("_was") == 0) & (now == 1), "pickup").when(F.col("_near") & (F.col("_was") == 1) & (now == 0), "dropoff").otherwise(""),
        }
    ).drop("_near", "_dt", "_m", "_h", "_was")


def drift(df: DataFrame, c: Settings = DEFAULT) -> DataFrame:
    """is_outlier_drift, from the rows on either side, across breaks too."""
    lat, lon, ts = F.col("latitude"), F.col("longitude"), F.col("timestamp")
    side = lambda f, x: f(x).over(by_time())
    plat, plon, nlat, nlon = side(F.lag, "latitude"), side(F.lag, "longitude"), side(F.lead, "latitude"), side(F.lead, "longitude")
    d = df.withColumns(
        {
            "_a": haversine_m(plat, plon, lat, lon, c.earth_radius_m),
            "_b": haversine_m(lat, lon, nlat, nlon, c.earth_radius_m),
            "_c": haversine_m(plat, plon, nlat, nlon, c.earth_radius_m),
            "_s": ts - side(F.lag, "timestamp"),
            "_t": side(F.lead, "timestamp") - ts,
        }
    )
    a, b, e, s, t = (F.col(x) for x in ("_a", "_b", "_c", "_s", "_t"))
    kmh = lambda m, sec: F.try_divide(m, sec) * 3.6
    fast = (kmh(a, s) > c.drift_speed_kmh) & (kmh(b, t) > c.drift_speed_kmh) & (kmh(e, s + t) < c.drift_speed_kmh)
    far = (a > c.drift_distance_m) & (b > c.drift_distance_m) & (e < c.drift_distance_m)
    cosine = F.try_divide(a * a + b * b - e * e, 2 * a * b)
    sharp = (a > 0) & (b > 0) & (F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))) < c.drift_angle_deg)
    flag = (s > 0) & (t > 0) & (F.coalesce(fast, F.lit(False)) | F.coalesce(far, F.lit(False)) | F.coalesce(sharp, F.lit(False)))
    return d.withColumn("is_outlier_drift", F.coalesce(flag, F.lit(False)).cast("int")).drop("_a", "_b", "_c", "_s", "_t")


def features(df: DataFrame, c: Settings = DEFAULT, day_start: int = 1488297600) -> DataFrame:
    """The feature table of core rows."""
    d = drift(lag_features(first_per_second(df), c), c)
    return d.withColumns(
        {
            "speed_reported_kmh": F.col("speed").try_cast("double"),
            "bad_coord": bad_coord(F.col("longitude"), F.col("latitude"), c.lon_range, c.lat_range),
            "out_of_day": out_of_day(F.col("timestamp"), day_start),
        }
    )


def segments(df: DataFrame, c: Settings = DEFAULT, into: str = "segment") -> DataFrame:
    """Numbers from 1; a new one at a vehicle's first row, a break, and time that stands still or leaps."""
    dt = F.col("timestamp") - F.lag("timestamp").over(by_time())
    edge = dt.isNull() | (F.coalesce("trip_break", F.lit(1)) == 1) | (dt <= 0) | (dt > c.max_gap_sec)
    return df.withColumn("_edge", edge.cast("int")).withColumn(into, F.sum("_edge").over(so_far_in_time())).drop("_edge")


def break_segments(df: DataFrame, into: str = "segment") -> DataFrame:
    """Breaks so far, from 0."""
    return df.withColumn(into, _running(F.col("trip_break")) - 1)


def runs(df: DataFrame, flag: Column, within: str | None = None, into: str = "run") -> DataFrame:
    """Islands of rows whose flag holds, within a segment; a row where it doesn't hold is an island of its own."""
    d = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    edge = ~F.col("_flag") | ~F.coalesce(F.lag("_flag").over(by_time()), F.lit(False))
    if within:
        edge = edge | ~F.col(within).eqNullSafe(F.lag(within).over(by_time()))
    return d.withColumn("_edge", edge.cast("int")).withColumn(into, F.sum("_edge").over(so_far_in_time())).drop("_edge")


def drop_parking(df: DataFrame, speed: str, c: Settings = DEFAULT, variant: str = "canonical") -> DataFrame:
    """W7, and W8 with variant script: without long runs at rest; the row after a run that went begins a segment.

    A run lasts until the next row of its segment (script: of its vehicle), or to its own last row.
    """
    within = "_seg" if variant == "canonical" else None
    d = segments(df, c, "_seg")
    d = runs(d, F.col(speed) == c.parking_speed_kmh, within, "_run")
    after = F.lead("timestamp").over(by_time())
    same = F.lead("_seg").over(by_time()) == F.col("_seg") if within else after.isNotNull()
    d = d.withColumn("_until", F.when(F.coalesce(same, F.lit(False)), after).otherwise(F.col("timestamp")))
    w = Window.partitionBy("taxi_id", "_run")
    d = d.withColumn("_gone", F.col("_flag") & ((F.max("_until").over(w) - F.min("timestamp").over(w)) >= c.parking_min_sec))
    if variant == "canonical":
        d = d.withColumn("trip_break", F.greatest("trip_break", F.coalesce(F.lag("_gone").over(by_time()), F.lit(True)).cast("int")))
    return d.where(~F.col("_gone")).drop("_seg", "_run", "_flag", "_until", "_gone")


def label_congestion(df: DataFrame, speed: str, c: Settings = DEFAULT, variant: str = "canonical") -> DataFrame:
    """W9, and W10 with variant script: congestion = 1 in long runs of low speed."""
    low = F.col(speed) < c.congestion_speed_kmh
    if variant == "canonical":
        d = runs(segments(df, c, "_seg"), low & (F.coalesce("bad_coord", F.lit(1)) == 0), "_seg", "_run")
    else:
        d = runs(df.withColumn("_seg", F.lit(0)), low, None, "_run")
    w = Window.partitionBy("taxi_id", "_run")
    lasts = F.max("timestamp").over(w) - F.min("timestamp").over(w)
    return d.withColumn("congestion", (F.col("_flag") & (lasts >= c.congestion_min_sec)).cast("int")).drop("_seg", "_run", "_flag")


def events_again(df: DataFrame) -> DataFrame:
    """event_type after rows were deleted."""
    was, now, joined = F.lag("occupied").over(by_time()), F.col("occupied"), F.col("trip_break") == 0
    return df.withColumn("event_type", F.when(joined & (was == 0) & (now == 1), "pickup").when(joined & (was == 1) & (now == 0), "dropoff").otherwise(""))


def drop_bad_coord(df: DataFrame) -> DataFrame:
    """without bad coordinates; the row after one begins a segment."""
    lost = F.coalesce(F.lag("bad_coord").over(by_time()), F.lit(1))
    return df.withColumn("trip_break", F.greatest("trip_break", (lost != 0).cast("int"))).where("bad_coord = 0")


def congestion_events(df: DataFrame, speed: str, c: Settings = DEFAULT, digits: int = 2) -> DataFrame:
    """Runs of low speed of two rows and three minutes at least, with the hexagon of their middle row."""
    broken = (F.col("trip_break") == 1) | (F.col("bad_coord") == 1)
    d = runs(df, ~broken & (F.col(speed) < c.event_speed_kmh), None, "_run").where("_flag")
    key = F.struct("timestamp", "src_seq")
    d = with_hexagon(d, c.hex_size_m).withColumn("_row", F.struct("timestamp", "src_seq", "latitude", "longitude", "q", "r"))
    w = Window.partitionBy("taxi_id", "_run").orderBy("timestamp", "src_seq")
    d = d.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("taxi_id", "_run"))})
    g = d.groupBy("taxi_id", "_run").agg(
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(speed), digits).alias("avg_speed_kmh"),
        F.avg(speed).alias("_avg"),
        F.min_by("_row", key).alias("_first"),
        F.max_by("_row", key).alias("_last"),
        F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col("_row"))).alias("_mid"),
    )
    lasts = F.col("end_ts") - F.col("start_ts")
    return g.where((F.col("n_rows") >= 2) & (lasts >= c.event_min_sec)).select(
        "taxi_id", "start_ts", "end_ts", lasts.alias("duration_sec"), "avg_speed_kmh", congestion_level(F.col("_avg")).alias("congestion_level"),
        F.col("_first.latitude").alias("start_lat"), F.col("_first.longitude").alias("start_lon"), F.col("_last.latitude").alias("end_lat"), F.col("_last.longitude").alias("end_lon"),
        F.col("_mid.q").alias("hex_q"), F.col("_mid.r").alias("hex_r"), likely_parked(lasts, c.likely_parked_sec).alias("likely_parked"),
    )


def with_hexagon(df: DataFrame, size: float, q: str = "q", r: str = "r") -> DataFrame:
    d = projection.with_utm(df, "longitude", "latitude", "_x", "_y")
    return hexgrid.with_axial(d, size, "_x", "_y", q, r).drop("_x", "_y")


def rides(df: DataFrame, c: Settings = DEFAULT) -> DataFrame:
    """Phases between changes of occupied: rides (kind trip) and searches for the next (kind idle).

    A row with a break or bad coordinates parts stretches and belongs to none. In a stretch, an island of equal occupied
    that another follows is a phase that ends with the follower's first row; the first island of a stretch is a ride
    only if its first row is a pickup.
    """
    off = (F.col("trip_break") == 1) | (F.col("bad_coord") == 1)
    d = df.withColumn("_off", off.cast("int")).withColumn("_stretch", F.sum("_off").over(so_far_in_time()))
    d = d.withColumn("_group", F.max_by("group_id", F.struct("timestamp", "src_seq")).over(Window.partitionBy("taxi_id"))).where("_off = 0")
    w = Window.partitionBy("taxi_id", "_stretch").orderBy("timestamp", "src_seq")
    changed = F.coalesce(F.lag("occupied").over(w) != F.col("occupied"), F.lit(True))
    step = haversine_m(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"), c.earth_radius_m)
    d = d.withColumns({"_new": changed.cast("int"), "_step": F.coalesce(step, F.lit(0.0))})
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"_island": F.sum("_new").over(so_far), "_walked": F.sum("_step").over(so_far)})
    first = F.min_by(F.struct("timestamp", "latitude", "longitude", "event_type", "_walked", "q", "r"), F.struct("timestamp", "src_seq"))
    g = with_hexagon(d, c.hex_size_m).groupBy("taxi_id", "_stretch", "_island").agg(first.alias("a"), F.first("occupied").alias("occupied"), F.first("_group").alias("group_id"))
    g = g.withColumn("b", F.lead("a").over(Window.partitionBy("taxi_id", "_stretch").orderBy("_island")))
    opened = (F.col("occupied") == 0) | (F.col("_island") > 1) | (F.col("a.event_type") == "pickup")
    g = g.where(F.col("b").isNotNull() & opened)
    metres, seconds = F.col("b._walked") - F.col("a._walked"), F.col("b.timestamp") - F.col("a.timestamp")
    straight = haversine_m(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"), c.earth_radius_m)
    average = F.when(seconds > 0, F.round(metres / seconds * 3.6, 2))
    return g.select(
        F.when(F.col("occupied") == 1, "trip").otherwise("idle").alias("kind"), "taxi_id", "group_id",
        F.col("a.timestamp").alias("start_ts"), F.col("a.latitude").alias("start_lat"), F.col("a.longitude").alias("start_lon"),
        F.col("b.timestamp").alias("end_ts"), F.col("b.latitude").alias("end_lat"), F.col("b.longitude").alias("end_lon"),
        seconds.alias("duration_sec"), F.round(metres, 1).alias("path_distance_m"), F.round(straight, 1).alias("straight_distance_m"), average.alias("avg_speed_kmh"),
        F.col("a.q").alias("start_hex_q"), F.col("a.r").alias("start_hex_r"), F.col("b.q").alias("end_hex_q"), F.col("b.r").alias("end_hex_r"),
        F.when(F.col("occupied") == 1, plausible_ride(seconds, average)).alias("is_plausible"),
    )


def gated_runs(df: DataFrame, variant: str = "canonical") -> DataFrame:
    """W14, and W15 with variant script: occupied runs that begin after an empty row in congestion, with origin and
    destination rows o and d; d is null where the run isn't seen to end.

    Canonical runs lie within a block without breaks; the script's within a vehicle.
    """
    d = df.withColumn("_block", _running(F.col("trip_break")) if variant == "canonical" else F.lit(0))
    w = Window.partitionBy("taxi_id", "_block").orderBy("timestamp", "src_seq")
    was, jam = F.lag("occupied").over(w), F.lag("congestion").over(w)
    d = d.withColumns({"_new": F.coalesce(was != F.col("occupied"), F.lit(True)).cast("int"), "_gate": F.coalesce((was == 0) & (jam == 1) & (F.col("occupied") == 1), F.lit(False))})
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    row = F.struct("timestamp", "src_seq", "longitude", "latitude")
    g = d.groupBy("taxi_id", "_block", "_island").agg(F.min(row).alias("o"), F.max("_gate").alias("gate"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("d", F.lead("o").over(Window.partitionBy("taxi_id", "_block").orderBy("_island")))
    return g.where("gate").select("taxi_id", "o", "d", "n")


def numbered(runs_: DataFrame, day: str, first: int = 1, complete_only: bool = False) -> DataFrame:
    """Trip ids in the order of vehicle and time, and route ids. Runs are few against pings; they are numbered by
    ranges of vehicles, so no task sorts them all."""
    d = runs_.where("d is not null") if complete_only else runs_
    per = d.groupBy("taxi_id").agg(F.count(F.lit(1)).alias("_c"))
    before = per.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("taxi_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    n = F.row_number().over(Window.partitionBy("taxi_id").orderBy("o.timestamp", "o.src_seq"))
    d = d.join(before, "taxi_id").withColumn("trip_id", (n + F.col("_before") + (first - 1)).cast("long")).drop("_before")
    return d.withColumns({"trip_date": F.lit(day), "route_id": route_id(F.lit(day), F.col("trip_id"))})


def trips(numbered_: DataFrame, c: Settings = DEFAULT) -> DataFrame:
    """Complete trips, with their plausibility (X11)."""
    km = haversine_m(F.col("o.latitude"), F.col("o.longitude"), F.col("d.latitude"), F.col("d.longitude"), c.earth_radius_m) / 1000
    seconds = (F.col("d.timestamp") - F.col("o.timestamp")).cast("double")
    return numbered_.where("d is not null").select(
        "route_id", "trip_date", "trip_id", "taxi_id", F.col("o.timestamp").alias("start_time"), F.col("o.longitude").alias("start_lon"), F.col("o.latitude").alias("start_lat"),
        F.col("d.timestamp").alias("end_time"), F.col("d.longitude").alias("end_lon"), F.col("d.latitude").alias("end_lat"),
        seconds.alias("duration_sec"), F.round(km, 6).alias("straight_line_km"), (F.col("n") + 1).cast("int").alias("n_points"), plausible_trip(seconds, km).alias("is_plausible"),
    )


def incomplete(numbered_: DataFrame) -> DataFrame:
    reason = F.lit("no_observed_dropoff_before_break_or_vehicle_end").alias("reason")
    return numbered_.where("d is null").select("route_id", "trip_date", "trip_id", "taxi_id", F.col("o.timestamp").alias("start_time"), F.col("o.longitude").alias("start_lon"), F.col("o.latitude").alias("start_lat"), reason)


def trip_points(df: DataFrame, numbered_: DataFrame) -> DataFrame:
    """The rows of each complete trip, origin to destination, numbered from 0.

    Trips and pings meet on the vehicle and the hour, so a vehicle with many trips doesn't pair them all with its pings.
    """
    t = numbered_.where("d is not null").select("route_id", "trip_date", "trip_id", "taxi_id", F.col("o.timestamp").alias("_a"), F.col("d.timestamp").alias("_b"))
    hour = lambda x: F.floor(x / 3600).cast("long")
    t = t.withColumn("_hour", F.explode(F.sequence(hour(F.col("_a")), hour(F.col("_b")))))
    d = df.withColumn("_hour", hour(F.col("timestamp"))).join(t, ["taxi_id", "_hour"]).where("timestamp between _a and _b")
    seq = F.row_number().over(Window.partitionBy("route_id").orderBy("timestamp", "src_seq")) - 1
    end = (F.col("timestamp") == F.col("_a")) | (F.col("timestamp") == F.col("_b"))
    return d.select("route_id", "trip_date", "trip_id", "taxi_id", seq.cast("int").alias("seq"), end.cast("int").alias("is_endpoint"), "timestamp", "longitude", "latitude", "occupied", "congestion")


def source_gaps(df: DataFrame, keep: Column) -> DataFrame:
    """The rows that keep holds for; trip_break = 1 where rows before one went, and at a vehicle's first."""
    d = df.withColumn("_i", F.row_number().over(by_time())).where(keep)
    gap = F.coalesce(F.col("_i") - F.lag("_i").over(by_time()) != 1, F.lit(True))
    return d.withColumn("trip_break", F.greatest(F.coalesce("trip_break", F.lit(1)), gap.cast("int"))).drop("_i")


def lines(points: DataFrame, key: str = "route_id", script: bool = False) -> DataFrame:
    """Points of each key in the order of seq as an array of (x, y); a single point gives null, or no row (script)."""
    g = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("longitude").alias("x"), F.col("latitude").alias("y")))).alias("_p"))
    g = g.select(key, F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    return g.where("size(points) >= 2") if script else g.withColumn("points", F.when(F.size("points") >= 2, F.col("points")))


def metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in, out and removed, as one row."""
    a, b = before.agg(F.count(F.lit(1)).alias("rows_input")), after.agg(F.count(F.lit(1)).alias("rows_output"))
    return a.join(b).withColumn("rows_removed", F.col("rows_input") - F.col("rows_output"))

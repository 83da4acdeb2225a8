"""Stages over days: each reads a table, writes a new one, and tells what it did.

A day is a folder below the run's; a stage whose folder is finished is skipped, one left half done is done again.
"""

from __future__ import annotations

import calendar
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings, StageResult
from ..functions.scalars import overlaps_daily
from ..operators import network as N
from ..operators import relational as R
from ..operators import trajectory as T
from ..operators.graphs import cut_lineage
from ..operators.polygons import flagged
from ..operators.relational import require_columns
from ..sources.sinks import finished, write_json

Stage = Callable[[DataFrame, Settings, str], DataFrame]


def features(d: DataFrame, c: Settings, day: str) -> DataFrame:
    return T.features(require_columns(d, ["taxi_id", "timestamp", "longitude", "latitude", "speed", "direction", "occupied", "src_seq"], "pings"), c, day_start(day, c))


def cleaned(d: DataFrame, c: Settings, day: str) -> DataFrame:
    """Without parking, with congestion and events anew."""
    return T.events_again(T.label_congestion(T.drop_parking(d, "speed_gps_kmh", c), "speed_gps_kmh", c))


def trips(d: DataFrame, c: Settings, day: str) -> DataFrame:
    return T.trips(T.numbered(T.gated_runs(T.source_gaps(d, F.col("bad_coord") == 0)), day), c)


#: The stages of a day in order.
STAGES: tuple[tuple[str, Stage], ...] = (("features", features), ("cleaned", cleaned), ("trips", trips))


def day_start(day: str, c: Settings = DEFAULT) -> int:
    """Epoch seconds of a local midnight."""
    return calendar.timegm(time.strptime(day, "%Y-%m-%d")) - c.utc_offset_sec


def run_stage(spark: SparkSession, name: str, stage: Stage, source: DataFrame, path: str, day: str, c: Settings = DEFAULT) -> StageResult:
    """One stage of one day; a failure is told, not raised."""
    begin = time.time()
    if finished(spark, path):
        return StageResult(name, "SKIPPED", {}, time.time() - begin)
    try:
        stage(source, c, day).write.mode("errorifexists").parquet(path)
        rows = spark.read.parquet(path).count()
    except Exception as e:  # whatever went wrong is the result
        return StageResult(name, "FAILED", {}, time.time() - begin, f"{type(e).__name__}: {str(e)[:500]}")
    return StageResult(name, "SUCCESS", {"rows": rows}, time.time() - begin)


def run_days(spark: SparkSession, days: dict[str, DataFrame], root: str, c: Settings = DEFAULT, execute: bool = True, stages: tuple[tuple[str, Stage], ...] = STAGES) -> list[StageResult]:
    """All stages of all days, in order; the first failure ends the run. Without execute nothing is written."""
    out: list[StageResult] = []
    for day, source in sorted(days.items()):
        d = source
        for name, stage in stages:
            path = f"{root}/trip_date={day}/{name}"
            if not execute:
                out.append(StageResult(f"{day} {name}", "SKIPPED", {}, 0.0))
                continue
            r = run_stage(spark, f"{day} {name}", stage, d, path, day, c)
            out.append(r)
            if r.status == "FAILED":
                return out
            d = spark.read.parquet(path)
    if execute and not finished(spark, f"{root}/summary"):
        write_json(spark, {r.stage: r.metrics for r in out}, f"{root}/summary")
    return out


def solve_path_sets(spark: SparkSession, trips_path: str, roads_path: str, out: str, c: Settings = DEFAULT) -> StageResult:
    """Path sets of the trips (route_id, sx, sy, ex, ey) and roads (osm_id, fclass, oneway, points) of two tables."""

    def stage(t: DataFrame, c: Settings, _: str) -> DataFrame:
        net = cut_lineage(N.largest_component(N.split(N.drivable(spark.read.parquet(roads_path)))))
        return N.route(N.snapped(t, net, c), N.edges(net), c)

    return run_stage(spark, "path sets", stage, spark.read.parquet(trips_path), out, "", c)


def select_morning(spark: SparkSession, paths_path: str, trips_path: str, areas: DataFrame, out: str, hours: tuple[int, int] = (7, 9), cell: float = 1000.0) -> StageResult:
    """The path sets of trips (route_id, start_time, end_time) that overlap the morning and whose paths meet an area.

    A trip that begins and ends at one place has no path; if trips have their ends (sx, sy, ex, ey), it is held against
    the areas by them.
    """

    def stage(p: DataFrame, c: Settings, _: str) -> DataFrame:
        t = spark.read.parquet(trips_path)
        morning = t.where(overlaps_daily(F.col("start_time"), F.col("end_time"), hours[0] * 60, hours[1] * 60))
        d = p.where("status = 'ok'").join(morning, "route_id", "left_semi").select("route_id", "alt_rank", "points")
        if {"sx", "sy", "ex", "ey"} <= set(t.columns):
            between = F.array(*[F.struct(F.col(f"{i}x").alias("x"), F.col(f"{i}y").alias("y")) for i in "se"])
            still = p.where("status = 'zero_distance'").select("route_id", "alt_rank")
            d = d.unionByName(still.join(morning.select("route_id", between.alias("points")), "route_id"))
        d = d.withColumn("_path", F.concat_ws("/", "route_id", "alt_rank"))
        met = flagged(d, "_path", "points", areas, cell).where("in_area = 1").select("route_id").distinct()
        return p.join(met, "route_id", "left_semi")

    return run_stage(spark, "morning selection", stage, spark.read.parquet(paths_path), out, "")


def final_export(spark: SparkSession, paths_path: str, actual_path: str, out: str, threshold: float = DEFAULT.detour_ratio) -> list[StageResult]:
    """Detours of the actual lines (route_id, points) of the selected paths, and a summary beside them."""

    def stage(a: DataFrame, c: Settings, _: str) -> DataFrame:
        shortest = spark.read.parquet(paths_path).where("alt_rank = 1")
        return R.detours(a.join(shortest.select("route_id"), "route_id", "left_semi"), shortest, threshold)

    done = run_stage(spark, "detours", stage, spark.read.parquet(actual_path), f"{out}/detours", "")
    if done.status == "FAILED":
        return [done]
    row = R.detour_summary(spark.read.parquet(f"{out}/detours")).first().asDict()
    if not finished(spark, f"{out}/summary"):
        write_json(spark, row, f"{out}/summary")
    return [done, StageResult("summary", "SUCCESS", row, 0.0)]

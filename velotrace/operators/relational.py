"""Joins, set operations and assertions of the trajectory pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from .graphs import cut_lineage

#: Bytes of a table that is bounded by the city and broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64_000_000


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    """Df, or an error that tells what is missing and what is there."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}; it has {df.columns}")
    return df


def require_crs(found: str | None, wanted: str, what: str = "layer") -> None:
    """An error unless a layer has a coordinate system, and the one that is wanted."""
    if not found:
        raise ValueError(f"{what} has no coordinate system")
    if found.upper() != wanted.upper():
        raise ValueError(f"{what} is in {found}, not in {wanted}")


def more_than(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The keys that more than n rows have, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n)


def _at_most(df: DataFrame, keys: list[str], n: int, what: str) -> DataFrame:
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    name = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    return df.withColumn("_n", count).where(F.when(F.col("_n") > n, F.raise_error(F.concat(F.lit(f"{what}: "), name)).cast("boolean")).otherwise(True)).drop("_n")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """U4: df, or an error at run time if a key is there twice."""
    return _at_most(df, keys, 1, "not unique")


def at_most(df: DataFrame, key: str, n: int = 2) -> DataFrame:
    """Df, or an error at run time if a key has more than n rows."""
    return _at_most(df, [key], n, "too many rows")


def stable_order(df: DataFrame, keys: list[str], into: str = "place") -> DataFrame:
    """O2: df with each row's place from 1 in an order that tells rows apart."""
    return numbered(df, keys, into).withColumn(into, F.col(into) + 1)


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of an order; each task hands on no more than n."""
    return df.orderBy(*order).limit(n)


def stacked(*frames: DataFrame) -> DataFrame:
    """The rows of all, by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def all_keys(key: str, *frames: DataFrame) -> DataFrame:
    """The keys that any of them has, each once."""
    return stacked(*[f.select(key) for f in frames]).distinct()


def first_per_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Of the rows of each key the values of the first in an order."""
    first = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_f")).select(*keys, *[F.col(f"_f.{v}") for v in values])


def population(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and standard deviation of a whole population."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def lines_with_trips(lines: DataFrame, trips: DataFrame, key: str = "trip_id") -> DataFrame:
    """Every line with the columns of its trip, null where there is none; trips are unique by key."""
    return lines.join(require_unique(trips, [key]), key, "left")


def qualified(df: DataFrame, inside: Column, key: str = "taxi_id") -> DataFrame:
    """All rows of the vehicles that have an occupied row inside."""
    ids = df.where(inside & (F.col("occupied") == 1)).select(key).distinct()
    return df.join(ids, key, "left_semi")


def with_lookup(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """A left join that fails at run time where the lookup lacks a key; its keys must be unique."""
    d = df.join(require_unique(lookup, [key]).withColumn("_there", F.lit(True)), key, "left")
    return d.where(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("_there")


def whole_segments(df: DataFrame, hit: Column, within: list[str]) -> DataFrame:
    """The rows of every segment with a hit."""
    w = Window.partitionBy(*within)
    return df.withColumn("_hit", F.max(hit.cast("int")).over(w)).where("_hit = 1").drop("_hit")


def in_cells(df: DataFrame, cells: DataFrame, keep: list[str]) -> DataFrame:
    """J6 on a raster: rank of the region whose cells (row, col, rank) hold a row's cell; -1 for none, the last of several."""
    last = cells.groupBy("row", "col").agg(F.max("rank").alias("rank"))
    return df.join(last, ["row", "col"], "left").select(*keep, F.coalesce("rank", F.lit(-1)).alias("candidate_rank"))


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """df to be broadcast if its rows, of so many bytes each, are known to take no more than BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Numbers rows from 0 in an order that tells them apart: ranges of it are sorted, and their counts, one a range, are
    added up, so no task holds all rows."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    d = cut_lineage(d).withColumn("_range", F.shiftrightunsigned("_at", 33))
    count = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    count = count.select("_range", before.alias("_before"))
    number = F.col("_before") + F.col("_at") - F.shiftleft("_range", 33)
    return d.join(F.broadcast(count), "_range").withColumn(into, number.cast("long")).drop("_range", "_before", "_at")


def squares(segments: DataFrame, tolerance: float, side: float, payload: list[str]) -> DataFrame:
    """(_c, _r, _near): for each square the segments that come within the tolerance of it.

    A segment is walked in steps no longer than a square; what lies near it lies near one of them.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    s = segments.select(F.struct("road_idx", *dict.fromkeys(["x1", "y1", "x2", "y2", *payload])).alias("_s"), "road_idx", "x1", "y1", "x2", "y2")
    steps = F.ceil(F.hypot(x2 - x1, y2 - y1) / side).cast("int") + 1
    s = s.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), steps - 1)))
    t = F.when(F.col("_n") > 1, F.col("_i") / (F.col("_n") - 1)).otherwise(0.0)
    around = tolerance + side / 2
    cells = lambda v: F.sequence(F.floor((v - around) / side).cast("long"), F.floor((v + around) / side).cast("long"))
    s = s.withColumn("_c", F.explode(cells(x1 + t * (x2 - x1)))).withColumn("_r", F.explode(cells(y1 + t * (y2 - y1))))
    return s.dropDuplicates(["road_idx", "_c", "_r"]).groupBy("_c", "_r").agg(F.collect_list("_s").alias("_near"))


#: Parts of a tolerance that are looked at first, as long as they are no less than so many metres.
NEARER, NEAR_METRES = (8, 4), 50.0


def with_nearest(points: DataFrame, segments: DataFrame, tolerance: float, payload: list[str], x: Column, y: Column, into: str) -> DataFrame:
    """For each row the nearest segment (road_idx, x1, y1, x2, y2) of its point within a distance, ties to the
    smaller road_idx: a struct of distance, road_idx, position along it and the payload, null where there is none.

    What is found within a part of a wide tolerance is the nearest of all, so few points look far. Roads are bounded by the
    city: their squares are written and broadcast behind a check of their bytes, so points aren't moved; parts whose
    squares would be more are left out. Where those of the whole tolerance are, points and squares are joined by a shuffle.
    """
    d = points.withColumns({"_x": x, "_y": y})
    found = None
    for part in (*NEARER, 1):
        reach = float(tolerance) / part
        if part > 1 and reach < NEAR_METRES:
            continue
        side = max(reach, min(4.0 * reach, 120.0))
        near = cut_lineage(squares(segments, reach, side, payload))
        entries = near.agg(F.coalesce(F.sum(F.size("_near")), F.lit(0))).first()[0]
        small = entries * (64 + 24 * len(payload)) + 64 * near.count() <= BROADCAST_BYTES
        if part > 1 and not small:
            continue
        d = d.withColumns({"_c": F.floor(F.col("_x") / side).cast("long"), "_r": F.floor(F.col("_y") / side).cast("long")})
        d = d.join(F.broadcast(near) if small else near, ["_c", "_r"], "left")
        best = _nearest(reach, payload)
        d = d.withColumn(into, best if found is None else F.when(F.col(into).isNull(), best).otherwise(F.col(into))).drop("_c", "_r", "_near")
        found = into
    return d.drop("_x", "_y")


def _nearest(reach: float, payload: list[str]) -> Column:
    """The nearest of the segments _near of a row's square within reach of its point."""

    def placed(s: Column) -> Column:
        away, along = geometry.point_segment(F.col("_x"), F.col("_y"), s["x1"], s["y1"], s["x2"], s["y2"])
        return F.struct(away.alias("distance"), s["road_idx"].alias("road_idx"), along.alias("position"), *[s[c].alias(c) for c in payload])

    return F.array_min(F.filter(F.transform("_near", placed), lambda s: s["distance"] <= reach))


def nearest_segment(points: DataFrame, segments: DataFrame, tolerance: float, payload: list[str]) -> DataFrame:
    """J8 and J9 for points (x, y): their columns with road_idx, distance, position and the payload, null where there is none."""
    d = with_nearest(points, segments, tolerance, payload, F.col("x"), F.col("y"), "_best")
    return d.select(*points.columns, "_best.road_idx", "_best.distance", "_best.position", *[F.col(f"_best.{c}") for c in payload])


def endpoints(trips: DataFrame) -> DataFrame:
    """A row for each end of a trip."""
    keys = ["route_id", "trip_id", "taxi_id"]
    side = lambda name, kind: trips.select(*keys, F.lit(kind).alias("point_type"), F.col(f"{name}_time").alias("timestamp"), F.col(f"{name}_lon").alias("longitude"), F.col(f"{name}_lat").alias("latitude"))
    return side("start", "O").unionByName(side("end", "D"))


def strided(df: DataFrame, key: str, n: int, i: int) -> DataFrame:
    """Every n-th row from the i-th on in the order of a key that is unique."""
    return numbered(df, [key], "_n").where(F.pmod(F.col("_n"), F.lit(n)) == i).drop("_n")


def detours(actual: DataFrame, shortest: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Actual lines (route_id, points) held against the shortest (route_id, dist_m, points): lengths, ratio,
    detour = 0 or 1, and a status; detour is null unless both are fine."""
    s = require_unique(shortest, ["route_id"]).select("route_id", F.col("dist_m").alias("optimal_length_m"), F.col("points").alias("_optimal"), F.lit(True).alias("_there"))
    d = actual.join(s, "route_id", "left").withColumn("_status", geometry.line_status(F.col("points")))
    length = F.when(F.col("_status") != "invalid_geometry", geometry.length(F.col("points")))
    d = d.withColumn("actual_length_m", length)
    optimal = F.col("optimal_length_m")
    status = (
        F.when(F.col("_status") == "invalid_geometry", "invalid_geometry")
        .when(F.col("_status") == "zero_length", "zero_actual_length")
        .when(F.col("_there").isNull(), "unmatched_route")
        .when(~geometry.finite(optimal) | (optimal <= 0), "nonpositive_optimal_length")
        .when(geometry.line_status(F.col("_optimal")) != "ok", "invalid_optimal_geometry")
        .otherwise("ok")
    )
    d = d.withColumn("comparison_status", status)
    ratio = F.when(F.col("comparison_status") == "ok", F.col("actual_length_m") / optimal)
    d = d.withColumn("detour_ratio", ratio).withColumn("detour", (F.col("detour_ratio") >= threshold).cast("int"))
    return d.drop("_status", "_optimal", "_there")


def detour_summary(d: DataFrame) -> DataFrame:
    """A10: eligible trips, detours, their rate, and how many were left out for what."""
    by = d.groupBy("comparison_status").agg(F.count(F.lit(1)).alias("n"), F.sum("detour").alias("detours"))
    return by.agg(
        F.coalesce(F.sum(F.when(F.col("comparison_status") == "ok", F.col("n"))), F.lit(0)).alias("eligible"),
        F.coalesce(F.sum("detours"), F.lit(0)).alias("detours"),
        F.try_divide(F.sum("detours"), F.sum(F.when(F.col("comparison_status") == "ok", F.col("n")))).alias("detour_rate"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("comparison_status") != "ok", F.struct("comparison_status", "n"))))).alias("excluded"),
    )

"""Trajectory operators on small fixtures."""

import random

from pyspark.sql import functions as F

from velotrace.config import Settings
from velotrace.operators import trajectory as T

#: Seconds from one row of a vehicle to the next, whether it is in congestion, occupied, and after a break.
STORY = {
    "x": [(0, 0, 0, 1), (30, 1, 0, 0), (45, 0, 1, 0), (20, 0, 1, 0), (25, 1, 0, 0), (40, 1, 1, 0), (35, 0, 0, 0), (50, 0, 1, 0), (15, 0, 0, 0)],
    "y": [(0, 1, 1, 1), (60, 1, 0, 0), (10, 0, 1, 1), (70, 1, 0, 0), (55, 0, 1, 0), (5, 0, 1, 0)],
    "z": [(0, 1, 1, 1), (90, 0, 0, 0)],
}


def story(spark):
    rows, n = [], 0
    for vehicle, steps in STORY.items():
        at = 7000
        for after, jam, busy, cut in steps:
            at, n = at + after, n + 1
            rows.append((vehicle, at, n, 116.2 + n / 500, 40.0 - n / 800, jam, busy, cut, 0))
    return spark.createDataFrame(rows, "taxi_id string, timestamp long, src_seq long, longitude double, latitude double, congestion int, occupied int, trip_break int, bad_coord int")


def test_trips_that_congestion_opens(spark):
    """x: two rides after an empty row in congestion, the third isn't; y: a break closes the gate, a ride isn't seen to end;
    z: nothing before its first ride."""
    d = story(spark)
    n = T.numbered(T.gated_runs(d), "2017-03-04")
    assert [(r.route_id, r.taxi_id, r.start_time, r.end_time) for r in T.trips(n).orderBy("trip_id").collect()] == [("20170304_1", "x", 7075, 7120), ("20170304_2", "x", 7160, 7195)]
    assert [(r.taxi_id, r.start_time, r.trip_id) for r in T.incomplete(n).collect()] == [("y", 7195, 3)]
    points = T.trip_points(d, n).orderBy("route_id", "seq").collect()
    assert [(p.timestamp, p.seq, p.is_endpoint) for p in points] == [(7075, 0, 1), (7095, 1, 0), (7120, 2, 1), (7160, 0, 1), (7195, 1, 1)]


def core(spark, rows):
    d = spark.createDataFrame(rows, "taxi_id string, timestamp long, occupied int, speed string")
    return d.withColumns({"src_seq": F.monotonically_increasing_id(), "group_id": F.lit("g"), "latitude": F.lit(39.9), "longitude": F.lit(116.4), "direction": F.lit(0.0), "positioning_valid": F.lit(1)})


def test_gap_and_repeated_seconds(spark):
    rows = [("a", 0, 0, "1"), ("a", 1800, 1, "1"), ("a", 1800, 0, "9"), ("a", 3601, 0, "1f5"), ("b", 5, 1, "")]
    got = {(r.taxi_id, r.timestamp): r for r in T.features(core(spark, rows).coalesce(1)).collect()}
    assert len(got) == 4
    assert got["a", 1800].trip_break == 0 and got["a", 1800].event_type == "pickup" and got["a", 1800].speed_reported_kmh == 1.0
    assert got["a", 3601].trip_break == 1 and got["a", 3601].event_type == "" and got["a", 3601].dt_sec is None and got["a", 3601].speed_reported_kmh is None
    assert got["b", 5].trip_break == 1


def labelled(spark, rows, **extra):
    d = spark.createDataFrame(rows, "taxi_id string, timestamp long, speed double, trip_break int")
    return d.withColumns({"src_seq": F.col("timestamp"), "bad_coord": F.lit(0), **extra})


def test_congestion_needs_four_minutes(spark):
    short = [("a", 0, 5.0, 1), ("a", 239, 5.0, 0), ("b", 0, 5.0, 1), ("b", 240, 5.0, 0)]
    got = T.label_congestion(labelled(spark, short), "speed").select("taxi_id", "congestion").distinct().collect()
    assert {(r.taxi_id, r.congestion) for r in got} == {("a", 0), ("b", 1)}


def test_parking_of_two_vehicles(spark):
    rows = [("a", 0, 0.0, 1), ("a", 1700, 0.0, 0), ("a", 3400, 0.0, 0), ("a", 3600, 9.0, 0), ("a", 3700, 9.0, 0), ("b", 0, 0.0, 1), ("b", 1700, 0.0, 0), ("b", 3399, 0.0, 0), ("b", 3599, 9.0, 0)]
    got = T.drop_parking(labelled(spark, rows), "speed").orderBy("taxi_id", "timestamp").collect()
    assert [(r.taxi_id, r.timestamp, r.trip_break) for r in got] == [("a", 3600, 1), ("a", 3700, 0), ("b", 0, 1), ("b", 1700, 0), ("b", 3399, 0), ("b", 3599, 0)]


def plain(rows, c):
    """Parking and congestion by loops over one vehicle's (ts, speed, trip_break)."""

    def segments(rs):
        out, n = [], 0
        for i, (t, _, b) in enumerate(rs):
            if not i or b or t - rs[i - 1][0] <= 0 or t - rs[i - 1][0] > c.max_gap_sec:
                n += 1
            out.append(n)
        return out

    def islands(flags, seg):
        i = 0
        while i < len(flags):
            j = i + 1
            while flags[i] and j < len(flags) and flags[j] and seg[j] == seg[i]:
                j += 1
            if flags[i]:
                yield i, j
            i = j

    seg, gone = segments(rows), set()
    for i, j in islands([s == 0 for _, s, _ in rows], seg):
        end = rows[j][0] if j < len(rows) and seg[j] == seg[i] else rows[j - 1][0]
        if end - rows[i][0] >= c.parking_min_sec:
            gone |= set(range(i, j))
    kept = [(t, s, 1 if i == 0 or i - 1 in gone else b) for i, (t, s, b) in enumerate(rows) if i not in gone]
    seg, jam = segments(kept), [0] * len(kept)
    for i, j in islands([s < c.congestion_speed_kmh for _, s, _ in kept], seg):
        if kept[j - 1][0] - kept[i][0] >= c.congestion_min_sec:
            jam[i:j] = [1] * (j - i)
    return [(t, b, x) for (t, _, b), x in zip(kept, jam)]


def test_parking_then_congestion_against_loops(spark):
    rng, c = random.Random(7), Settings(parking_min_sec=300, congestion_min_sec=100, max_gap_sec=200)
    rows, want = [], []
    for v in range(120):
        t, mine = 0, []
        for i in range(rng.randint(1, 30)):
            t += rng.choice([10, 60, 150, 250])
            mine.append((t, rng.choice([0.0, 0.0, 0.0, 8.0, 30.0]), int(i == 0 or rng.random() < 0.1)))
        rows += [(str(v), *r) for r in mine]
        want += [(str(v), *r) for r in plain(mine, c)]
    d = T.label_congestion(T.drop_parking(labelled(spark, rows), "speed", c), "speed", c)
    assert sorted((r.taxi_id, r.timestamp, r.trip_break, r.congestion) for r in d.collect()) == sorted(want)


def test_one_shuffle_for_the_whole_chain(spark):
    d = T.label_congestion(T.drop_parking(T.features(core(spark, [("a", 0, 0, "1")])), "speed_gps_kmh"), "speed_gps_kmh")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

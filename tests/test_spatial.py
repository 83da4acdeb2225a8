"""Spatial, space-time and routing operators on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velotrace.config import Settings
from velotrace.operators import graphs, grids, network, relational


@pytest.mark.parametrize("script", [False, True])
def test_kernel_adds_up_to_one(script):
    assert abs(sum(w for _, _, w in grids.kernel(800.0, 20.0, script)) - 1) < 0.01


def test_density_against_a_dense_convolution(spark):
    grid = grids.Grid(0, 0, 1000, 1500, 100.0)
    rng = np.random.default_rng(3)
    points = rng.uniform(-50, 1600, (300, 2))
    d = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    got = {(r.row, r.col): r.value for r in grids.density(grids.histogram(d, grid), grid, 350.0).collect()}
    dense = np.zeros((15, 10))
    for x, y in points:
        if 0 <= x < 1000 and 0 <= y < 1500:
            for i, j, w in grids.kernel(350.0, 100.0):
                r, c = 14 - int(y // 100) + i, int(x // 100) + j
                if 0 <= r < 15 and 0 <= c < 10:
                    dense[r, c] += w * 100
    assert all(abs(got.get((r, c), 0) - dense[r, c]) < 1e-9 for r in range(15) for c in range(10))


@pytest.mark.parametrize("local", [10**6, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(graphs, "LOCAL_EDGES", local)
    cells = spark.createDataFrame([(0, 0), (1, 1), (3, 3), (3, 4), (9, 0)], "row long, col long")
    got = {(r.row, r.col): r.label for r in graphs.raster_components(cells).collect()}
    assert got == {(0, 0): 1, (1, 1): 1, (3, 3): 2, (3, 4): 2, (9, 0): 3}
    hexes = spark.createDataFrame([(0, 0), (1, -1), (1, 1), (5, 5), (6, 5), (7, 5)], "q long, r long")
    got = {(r.q, r.r): r.cluster_id for r in graphs.hex_components(hexes).collect()}
    assert got[5, 5] == got[7, 5] == 1 and got[0, 0] == got[1, -1] == 2 and got[1, 1] == 3


def test_negative_cells_keep_their_place(spark):
    cells = spark.createDataFrame([(-3, -4), (-2, -4), (-2147483, 2147483)], "row long, col long")
    got = {(r.row, r.col): r.label for r in graphs.raster_components(cells).collect()}
    assert set(got) == {(-3, -4), (-2, -4), (-2147483, 2147483)} and got[-3, -4] == got[-2, -4] == 2


def one(spark, c):
    return spark.range(1).select(c.alias("r")).first()[0]


@pytest.mark.parametrize("values,z", [([1.0, 2, 3, 4, 5], 2.2045), ([1.0, 2, 3, 4], 1.6984), ([1.0, 1, 1], 0.0), ([2.0], 0.0), ([5.0, 4, 3, 2, 1], -2.2045)])
def test_trend(spark, values, z):
    assert abs(one(spark, grids.mann_kendall(F.array(*map(F.lit, values)))) - z) < 1e-3


@pytest.mark.parametrize(
    "gi,mk,name",
    [
        ([0.0] * 5, 0.0, "no_pattern_detected"), ([3.0, -3.0, 0.0], 0.0, "oscillating_hotspot"), ([3.0] * 5, 2.2, "intensifying_hotspot"), ([3.0] * 5, -2.2, "diminishing_hotspot"), ([3.0] * 5, 0.0, "persistent_hotspot"),
        ([-3.0] * 5, 0.0, "persistent_coldspot"), ([0.0, 0.0, 3.0, 3.0], 0.0, "consecutive_hotspot"), ([0.0, 3.0, 0.0, 3.0], 0.0, "sporadic_hotspot"), ([0.0, 0.0, 3.0], 0.0, "sporadic_hotspot"), ([0.0, -3.0], 0.0, "sporadic_coldspot"),
    ],
)
def test_patterns(spark, gi, mk, name):
    assert one(spark, grids.pattern(F.array(*map(F.lit, gi)), F.lit(mk))) == name


def test_gi_star_of_equal_values_is_zero(spark):
    d = spark.createDataFrame([(q, r, 1, 4.0) for q in range(3) for r in range(3)], "q long, r long, label int, v double")
    assert {r.gi_star for r in grids.gi_star(d, "v").collect()} == {0.0}


def test_fishnet_keeps_lengths(spark):
    rng = random.Random(2)
    rows = [(i, *[rng.uniform(-1000, 1000) for _ in range(4)]) for i in range(50)] + [(50, 0.0, 0.0, 500.0, 0.0), (51, 0.0, 10.0, 0.0, 900.0)]
    d = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r.m for r in grids.fishnet_lengths(d, 250.0, ["id"]).groupBy("id").agg(F.sum("metres").alias("m")).collect()}
    assert all(abs(got[i] - math.hypot(c - a, e - b)) < 1e-6 for i, a, b, c, e in rows)


@pytest.mark.parametrize("tolerance,held", [(30.0, True), (30.0, False), (200.0, True), (600.0, True), (600.0, False)])
def test_nearest_segment_against_all_pairs(spark, monkeypatch, tolerance, held):
    if not held:
        monkeypatch.setattr(relational, "BROADCAST_BYTES", 0)
    rng = random.Random(4)
    segs = [(i, *[rng.uniform(0, 1000) for _ in range(4)]) for i in range(40)] + [(40, 0.0, 500.0, 1000.0, 500.0), (41, 0.0, 500.0, 1000.0, 500.0)]
    points = [(i, rng.uniform(-100, 1100), rng.uniform(-100, 1100)) for i in range(200)] + [(200, 30.0, 530.0), (201, 500.0, 500.0)]

    def distance(px, py, x1, y1, x2, y2):
        t = min(max(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1)
        return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))

    got = relational.nearest_segment(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(segs, "road_idx long, x1 double, y1 double, x2 double, y2 double"), tolerance, [])
    for r in got.collect():
        near = [(distance(r.x, r.y, *s[1:]), s[0]) for s in segs]
        best = min(near)
        if best[0] > tolerance + 1e-9:
            assert r.road_idx is None
        elif best[0] < tolerance - 1e-9:
            assert abs(r.distance - best[0]) < 1e-9 and r.road_idx == min(i for d, i in near if abs(d - best[0]) < 1e-12)


def road(i, *points, oneway="B", fclass="primary"):
    return (str(i), fclass, oneway, [(float(x), float(y)) for x, y in points])


KIND = "osm_id string, fclass string, oneway string, points array<struct<x:double,y:double>>"


def routes(spark, roads, trips, c=None):
    c = c or Settings()
    segs = network.split(network.drivable(spark.createDataFrame(roads, KIND)))
    t = spark.createDataFrame(trips, "route_id string, sx double, sy double, ex double, ey double")
    return network.route(network.snapped(t, segs, c), network.edges(segs), c)


def test_statuses_of_routes(spark):
    roads = [road(1, (0, 0), (1000, 0)), road(2, (1000, 0), (2000, 0), oneway="F"), road(3, (5000, 5000), (6000, 5000)), road(4, (0, 0), (9, 9), fclass="footway")]
    trips = [("same", 100.0, 5.0, 300.0, -5.0), ("way", 500.0, 0.0, 1500.0, 0.0), ("wrong_way", 1500.0, 0.0, 500.0, 0.0), ("zero", 50.0, 3.0, 50.0, -3.0), ("far", 0.0, 900.0, 10.0, 0.0), ("apart", 10.0, 0.0, 5500.0, 5000.0)]
    got = {r.route_id: r for r in routes(spark, roads, trips).where("alt_rank = 1").collect()}
    assert (got["same"].dist_m, got["same"].n_edges, got["same"].status) == (200.0, 1, "ok")
    assert got["way"].dist_m == 1000.0 and [tuple(p) for p in got["way"].points] == [(500, 0), (1000, 0), (1500, 0)]
    assert got["wrong_way"].status == "no_path" and got["apart"].status == "no_path"
    assert got["zero"].status == "zero_distance" and got["far"].status == "snap_far"


@pytest.mark.parametrize("height,alternatives", [(90.0, 2), (150.0, 1)])
def test_alternatives_have_a_limit(spark, height, alternatives):
    """A way round of 1.15 or 1.25 times the straight one."""
    roads = [road(1, (0, 0), (100, 0)), road(2, (100, 0), (1100, 0)), road(3, (1100, 0), (1200, 0)), road(4, (100, 0), (100, height)), road(5, (100, height), (1100, height)), road(6, (1100, height), (1100, 0))]
    got = routes(spark, roads, [("r", 10.0, 0.0, 1190.0, 0.0)], Settings(alternative_attempts=20)).orderBy("alt_rank").collect()
    assert len(got) == alternatives and got[0].dist_m == 1180.0
    assert network.path_faults(routes(spark, roads, [("r", 10.0, 0.0, 1190.0, 0.0)])).count() == 0


def test_shortest_paths_against_all_pairs(spark):
    rng = random.Random(6)
    nodes = [(rng.uniform(0, 2000), rng.uniform(0, 2000)) for _ in range(25)]
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(60)}
    ways = {p: "B" for p in pairs}  # a trip that begins at a crossing may be snapped to any street there
    roads = [road(i, nodes[a], nodes[b], oneway=ways[a, b]) for i, (a, b) in enumerate(sorted(pairs))]
    d = np.full((25, 25), np.inf)
    np.fill_diagonal(d, 0)
    for (a, b), w in ways.items():
        m = math.dist(nodes[a], nodes[b])
        if w in "BF":
            d[a, b] = m
        if w in "BT":
            d[b, a] = m
    for k in range(25):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :])
    used = sorted({x for p in pairs for x in p})
    ends = [(a, b) for a in used for b in used if a != b][:120]
    got = routes(spark, roads, [(f"{a}_{b}", *nodes[a], *nodes[b]) for a, b in ends]).where("alt_rank = 1").collect()
    for r in got:
        a, b = map(int, r.route_id.split("_"))
        assert (r.dist_m is None) == np.isinf(d[a, b]) and (r.dist_m is None or abs(r.dist_m - d[a, b]) < 1e-6)


@pytest.mark.parametrize("local", [10**6, 0])
def test_largest_component(spark, monkeypatch, local):
    """On the driver and by rounds of joins alike; of equally large ones that of the least key."""
    monkeypatch.setattr(network, "LOCAL_SEGMENTS", local)
    roads = [road(1, (9, 9), (8, 9), (7, 9)), road(2, (1, 1), (2, 1)), road(3, (2, 1), (3, 1)), road(4, (50, 50), (60, 50))]
    got = network.largest_component(network.split(network.drivable(spark.createDataFrame(roads, KIND)))).orderBy("road_idx").collect()
    assert [(r.road_idx, r.osm_id) for r in got] == [(0, "2"), (1, "3")]


def test_largest_label_of_a_long_chain():
    n = 5000
    order = np.random.default_rng(1).permutation(n)
    assert network.largest_label(order[:-1], order[1:], n).all()
    assert network.largest_label(np.array([0, 3, 4]), np.array([1, 4, 5]), 6).tolist() == [False, False, False, True, True, True]


def test_direct_ways(spark):
    rows = [("B", 3.0, 8.0, 5.0), ("B", 8.0, 3.0, 5.0), ("F", 3.0, 8.0, 5.0), ("F", 8.0, 3.0, None), ("T", 8.0, 3.0, 5.0), ("T", 3.0, 8.0, None), ("B", 3.0, 3.0, None)]
    d = spark.createDataFrame([(((1, a, way), (1, b, way)), want) for way, a, b, want in rows], "p struct<s:struct<road_idx:int,position:double,oneway:string>,e:struct<road_idx:int,position:double,oneway:string>>, want double")
    assert all(r.got == r.want for r in d.select("want", network.direct_metres(F.col("p.s"), F.col("p.e")).alias("got")).collect())


def test_no_more_edges_than_a_task_may_hold(spark, monkeypatch):
    monkeypatch.setattr(network, "GRAPH_BYTES", 100)
    with pytest.raises(ValueError, match="regions"):
        routes(spark, [road(1, (0, 0), (1000, 0))], [("r", 10.0, 0.0, 1190.0, 0.0)])


def test_detours(spark):
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    actual = [("a", line((0, 0), (149, 0))), ("b", line((0, 0), (150, 0))), ("none", line((0, 0), (1, 0))), ("zero", line((0, 0), (0, 0))), ("null", None), ("flat", line((0, 0), (1, 0)))]
    best = [("a", 100.0, line((0, 0), (1, 0))), ("b", 100.0, line((0, 0), (1, 0))), ("zero", 1.0, None), ("flat", 0.0, line((0, 0), (1, 0)))]
    points = "points array<struct<x:double,y:double>>"
    d = relational.detours(spark.createDataFrame(actual, f"route_id string, {points}"), spark.createDataFrame(best, f"route_id string, dist_m double, {points}"))
    got = {r.route_id: (r.detour, r.comparison_status) for r in d.collect()}
    assert got == {"a": (0, "ok"), "b": (1, "ok"), "none": (None, "unmatched_route"), "zero": (None, "zero_actual_length"), "null": (None, "invalid_geometry"), "flat": (None, "nonpositive_optimal_length")}
    s = relational.detour_summary(d).first()
    assert (s.eligible, s.detours, s.detour_rate) == (2, 1, 0.5) and sum(s.excluded.values()) == 4


def test_no_rows(spark):
    d = relational.detours(spark.createDataFrame([], "route_id string, points array<struct<x:double,y:double>>"), spark.createDataFrame([], "route_id string, dist_m double, points array<struct<x:double,y:double>>"))
    assert relational.detour_summary(d).first().detour_rate is None

"""Rules at their borders."""

import math

import pytest
from pyspark.sql import functions as F

from velotrace.config import Settings
from velotrace.functions import geometry, hexgrid, projection, scalars


def one(spark, column, **values):
    literals = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*literals).select(column.alias("r")).first()[0]


def c(name):
    return F.col(name)


def test_heading_wraps(spark):
    assert one(spark, scalars.heading_delta(c("a"), c("b")), a=350.0, b=10.0) == 20.0
    assert one(spark, scalars.heading_delta(c("a"), c("b")), a=0.0, b=180.0) == 180.0


@pytest.mark.parametrize("text,value", [("1f5", None), ("1f", None), ("1d", None), ("", None), ("nan", None), (" 12.5 ", 12.5), ("-.5", -0.5), ("3e2", 300.0)])
def test_numbers_as_python_reads_them(spark, text, value):
    assert one(spark, scalars.parse_number(c("t")), t=text) == value


@pytest.mark.parametrize("lon,lat,bad", [(73.0, 18.0, 0), (135.0, 53.0, 0), (72.999, 30.0, 1), (100.0, 53.001, 1)])
def test_country_box_includes_its_border(spark, lon, lat, bad):
    assert one(spark, scalars.bad_coord(c("x"), c("y")), x=lon, y=lat) == bad


@pytest.mark.parametrize("kmh,level", [(10.0, 3), (10.01, 2), (20.0, 2), (20.01, 1), (30.0, 1), (30.01, 0)])
def test_congestion_levels(spark, kmh, level):
    assert one(spark, scalars.congestion_level(c("v")), v=kmh) == scalars.LEVELS[level]


@pytest.mark.parametrize("hhmm,label", [("07:00", "morning_peak"), ("08:59", "morning_peak"), ("09:00", "off_peak"), ("17:00", "evening_peak"), ("19:00", "off_peak")])
def test_peaks(spark, hhmm, label):
    h, m = map(int, hhmm.split(":"))
    ts = 1488297600 + h * 3600 + m * 60
    assert one(spark, scalars.peak_label(c("t")), t=ts) == label


def test_no_time_is_invalid(spark):
    assert one(spark, scalars.peak_label(F.lit(None).cast("long"))) == "invalid_time"


def test_daily_windows(spark):
    day = 1488297600  # midnight, local
    w = lambda a, b: one(spark, scalars.overlaps_daily(c("a"), c("b"), 420, 540), a=day + a, b=day + b)
    assert not w(6 * 3600, 7 * 3600)  # ends as the window opens
    assert w(6 * 3600, 7 * 3600 + 1)
    assert not w(9 * 3600, 10 * 3600)
    assert w(20 * 3600, 86400 + 8 * 3600)  # the next day's window
    assert not w(8 * 3600, 8 * 3600)
    night = one(spark, scalars.overlaps_daily(c("a"), c("b"), 22 * 60, 2 * 60), a=day + 23 * 3600, b=day + 24 * 3600)
    assert night


def test_one_way_words(spark):
    assert [one(spark, scalars.one_way(c("w")), w=x) for x in ("", "none", "b", " f", "T")] == ["B", "B", "B", "F", "T"]
    with pytest.raises(Exception, match="unknown one-way"):
        one(spark, scalars.one_way(c("w")), w="x")


def test_file_days(spark):
    assert one(spark, scalars.day_of_file(c("n")), n="trip0307.shp") == "2017-03-07"
    assert one(spark, scalars.day_of_file(c("n")), n="trip20170307.shp") is None


def test_projection(spark):
    d = spark.createDataFrame([(117.0, 40.0), (116.4, 39.9)], "longitude double, latitude double")
    rows = projection.with_utm(d).collect()
    assert abs(rows[0].x - 500000) < 1e-6 and abs(rows[0].y - 4427757.218738) < 1e-4
    assert abs(rows[1].x - 448709.380192) < 1e-4 and abs(rows[1].y - 4416830.562172) < 1e-4
    lon, lat = projection.inverse(F.col("x"), F.col("y"))
    back = projection.with_utm(d).select(lon.alias("a"), lat.alias("b"), "longitude", "latitude").collect()
    assert all(abs(r.a - r.longitude) < 1e-11 and abs(r.b - r.latitude) < 1e-11 for r in back)


def test_hexagons_hold_their_middle(spark):
    assert abs(hexgrid.circumradius(300) - 186.12097182) < 1e-8
    d = spark.range(400).select((F.col("id") % 20 - 10).alias("a"), (F.floor(F.col("id") / 20) - 10).alias("b"))
    x, y = hexgrid.centre(F.col("a"), F.col("b"), 300.0)
    d = hexgrid.with_axial(d.withColumns({"x": x, "y": y}), 300.0)
    assert d.where("q <> a or r <> b").count() == 0


RING = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]


@pytest.mark.parametrize("x,y,strict,border", [(1.0, 1.0, True, True), (2.0, 1.0, False, True), (2.0, 3.0, False, False), (0.0, 2.0, False, True), (5.0, 1.0, False, False), (float("nan"), 1.0, False, False)])
def test_points_and_rings(spark, x, y, strict, border):
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in RING])
    assert one(spark, geometry.in_ring(c("x"), c("y"), ring), x=x, y=y) is strict
    assert one(spark, geometry.in_ring(c("x"), c("y"), ring, True), x=x, y=y) is border


def test_lines(spark):
    line = lambda *p: F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in p])
    assert one(spark, geometry.length(line((0, 0), (3, 4), (3, 5)))) == 6.0
    assert one(spark, geometry.line_status(line((0, 0)))) == "invalid_geometry"
    assert one(spark, geometry.line_status(line((1, 1), (1, 1)))) == "zero_length"
    merged = one(spark, geometry.merge_lines(F.array(line((0, 0), (1, 0)), line((1, 0), (1, 1)), line((1, 1), (1, 1)))))
    assert [(p.x, p.y) for p in merged] == [(0, 0), (1, 0), (1, 1)]
    square = line((0, 0), (2, 0), (2, 2), (0, 2))
    assert one(spark, geometry.line_meets_ring(line((-1, 1), (3, 1)), square))
    assert not one(spark, geometry.line_meets_ring(line((-1, 3), (3, 3)), square))


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(hotspot_top_fraction=1.5)
    assert math.isclose(Settings().earth_radius_m, 6371008.8)

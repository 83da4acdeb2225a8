"""Sources and sinks, each written and read back."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types

from velotrace.operators import grids, relational
from velotrace.sources import geometry, pings, sinks
from velotrace.streaming import pings as stream

GOOD = "1\t7\t1488297600\t12\t3990000\t11640000\t90\t\t\t\t\t\t定位有效 重车"


def test_raw_lines(spark, tmp_path):
    bad = [GOOD.rsplit("\t", 1)[0], GOOD + "\tx", GOOD.replace("1488297600", "14882976.5"), GOOD.replace("3990000", "39n"), "", GOOD.replace("\t90\t", "\tnorth\t")]
    (tmp_path / "raw.txt").write_text("\n".join([GOOD, *bad]) + "\n", encoding="utf-8")
    rows = pings.read_raw(spark, str(tmp_path / "raw.txt")).collect()
    assert len(rows) == 2  # a bad direction is null and keeps the row
    assert (rows[0].latitude, rows[0].longitude, rows[0].occupied, rows[0].positioning_valid) == (39.9, 116.4, 1, 1)
    assert rows[1].direction is None
    assert pings.read_raw(spark, str(tmp_path / "raw.txt"), limit=1).count() == 1


def test_csv(spark, tmp_path):
    d = pings.raw_lines(spark.createDataFrame([(GOOD,)], "value string")).drop("ok")
    sinks.write_csv(d, str(tmp_path / "c"))
    with pytest.raises(Exception, match="exist"):
        sinks.write_csv(d, str(tmp_path / "c"))
    assert pings.read_csv(spark, str(tmp_path / "c")).collect() == d.collect()


def test_csv_rows_do_not_depend_on_what_is_selected(spark, tmp_path):
    """A bad direction or speed alone is null; a bad time, a short line or a bad place is no row, whatever is read of it."""
    good = "1,7,1488297600,12,39.9,116.4,90,1,1"
    lines = [good, good.replace(",90,", ",north,"), good.replace("12,39.9", "fast,39.9"), good.replace("1488297600", "12x"), good.replace("39.9", ""), good.rsplit(",", 1)[0], good + ",more", '"1,x",7,1488297600,12,39.9,116.4,90,1,1']
    (tmp_path / "a.csv").write_text("\n".join([",".join(pings.CORE.names), *lines]) + "\n", encoding="utf-8")
    d = pings.read_csv(spark, str(tmp_path / "a.csv"))
    assert d.count() == len(d.collect()) == d.select("taxi_id").count() == len(d.select("direction").collect()) == 5
    assert sorted(str(r.direction) for r in d.collect()) == ["90.0"] * 4 + ["None"]
    p = pings.read_positional(spark, str(tmp_path / "a.csv"))
    assert p.count() == len(p.collect()) == p.select("direction").count() == 4
    assert {r.group_id for r in p.collect()} == {"1", "1,x"}
    with pytest.raises(ValueError, match="lacks"):
        pings.read_csv(spark, str(tmp_path / "a.csv"), types.StructType([*pings.CORE.fields, types.StructField("altitude", types.DoubleType())]))


def test_a_mark_before_the_header(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, "度")], "a int, b string"), str(tmp_path / "m"))
    raw = next((tmp_path / "m").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfa,b") and spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["a", "b"]


def test_charsets(spark, tmp_path):
    for name, charset in (("u", "utf-8"), ("g", "gbk")):
        (tmp_path / name).write_bytes("name,wkt\n五环路,\"LINESTRING (1 2, 3 4)\"\n".encode(charset))
        assert geometry.read_wkt(spark, str(tmp_path / name)).first().name == "五环路"


def test_rows_are_counted_and_appended(spark, tmp_path):
    d = spark.createDataFrame([(1, [(0.5, 1.0), (2.0, 3.0)])], "id long, points array<struct<x:double,y:double>>")
    for kind in ("geojson", "csv", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        assert sinks.write_vector(d, "points", path) == 1
        with pytest.raises(FileExistsError):
            sinks.write_vector(d, "points", path)
        assert sinks.write_vector(d.unionAll(d), "points", path, append=True) == 2
    with pytest.raises(ValueError, match="no format"):
        sinks.write_vector(d, "points", str(tmp_path / "t.shp"))
    with pytest.raises(RuntimeError, match="1 rows were written, 0 are there"):
        sinks.checked(d, lambda x: x.write.format("noop").mode("overwrite").save(), lambda: 0)


def test_a_replacement_that_was_cut_off(spark, tmp_path):
    """The old data are found again where the new ones had not come into place."""
    path = tmp_path / "r"
    sinks.replace(spark.range(4), str(path))
    path.rename(tmp_path / "r.old")
    sinks.replace(spark.range(5), str(path))
    assert spark.read.parquet(str(path)).count() == 5 and not (tmp_path / "r.old").exists()


def test_run_folders(spark, tmp_path):
    assert not (tmp_path / sinks.new_run(spark, str(tmp_path), "a", execute=False)).exists()
    assert (tmp_path / "a") == type(tmp_path)(sinks.new_run(spark, str(tmp_path), "a")) and (tmp_path / "a").is_dir()
    with pytest.raises(FileExistsError):
        sinks.new_run(spark, str(tmp_path), "a")


def test_rasters(spark, tmp_path):
    cells = grids.stack({"a": spark.createDataFrame([(0, 1, 2.0)], "row long, col long, value double")})
    spec = {"cell": 150.0, "width": 3}
    sinks.write_raster(cells, spec, str(tmp_path / "r"))
    assert sinks.read_raster(spark, str(tmp_path / "r"), spec).count() == 1
    with pytest.raises(ValueError):
        sinks.read_raster(spark, str(tmp_path / "r"), {"cell": 100.0, "width": 3})


def test_lines(spark, tmp_path):
    d = spark.createDataFrame([(1, [(0.5, 1.0), (2.0, 3.0)])], "id long, points array<struct<x:double,y:double>>")
    sinks.write_geojson(d, "points", str(tmp_path / "g"))
    back = geometry.read_geojson(spark, str(tmp_path / "g")).first()
    assert [tuple(p) for p in back.points] == [(0.5, 1.0), (2.0, 3.0)] and back.properties == {"id": "1"}
    d.select("id", sinks.wkt_line(F.col("points")).alias("wkt")).write.option("header", True).csv(str(tmp_path / "w"))
    assert [tuple(p) for p in geometry.read_wkt(spark, str(tmp_path / "w")).first().points] == [(0.5, 1.0), (2.0, 3.0)]
    poly = spark.range(1).select(geometry.wkt_points(F.lit("POLYGON ((0 0, 1 0, 1 1, 0 0), (5 5, 6 6, 5 6, 5 5))")).alias("p")).first().p
    assert len(poly) == 4


def test_days_and_shards(spark, tmp_path):
    d = spark.createDataFrame([(4,)], "trip_id long")
    d.coalesce(1).write.parquet(str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("part*.parquet"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "trip0305.parquet").write_bytes(part.read_bytes())
    (tmp_path / "in" / "deep" / "x.parquet").write_bytes(part.read_bytes())
    r = geometry.read_days(spark, str(tmp_path / "in" / "trip*.parquet")).first()
    assert (r.trip_date, r.route_id) == ("2017-03-05", "20170305_4")
    assert geometry.read_shards(spark, str(tmp_path / "in")).count() == 2


def test_parts_json_replace_and_marks(spark, tmp_path):
    d = spark.range(25).coalesce(1)
    sinks.write_parts(d, str(tmp_path / "p"), rows=10)
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 3
    sinks.write_json(spark, {"度": 1}, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"度": 1}
    sinks.replace(spark.range(3), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert sinks.finished(spark, str(tmp_path / "p"))
    (tmp_path / "half").mkdir()
    (tmp_path / "half" / "part-0").write_text("x")
    assert not sinks.finished(spark, str(tmp_path / "half")) and not (tmp_path / "half").exists()


def test_assertions(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="lacks"):
        relational.require_columns(d, ["k", "z"])
    with pytest.raises(Exception, match="not unique"):
        relational.require_unique(d, ["k"]).collect()
    with pytest.raises(Exception, match="too many"):
        relational.at_most(d, "k", 1).collect()
    with pytest.raises(Exception, match="no match"):
        relational.with_lookup(d, spark.createDataFrame([(1, 5)], "k int, w int"), "k").collect()
    assert relational.require_unique(d, ["k", "v"]).count() == 3


def test_sessions_of_a_stream(spark, tmp_path):
    kind = "taxi_id string, timestamp long, speed double, latitude double, longitude double"
    rows = [("a", 1000, 1.0, 39.9, 116.4), ("a", 1500, 3.0, 39.9, 116.4), ("a", 9000, 5.0, 39.9, 116.4), ("b", 90000, 1.0, 39.9, 116.4)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    q = stream.write(stream.sessions(stream.read(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema)), str(tmp_path / "out"), str(tmp_path / "mark"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start_ts").collect()
    assert [(r.taxi_id, r.start_ts, r.end_ts, r.n, r.mean_speed_kmh) for r in got] == [("a", 1000, 1500, 2, 2.0), ("a", 9000, 9000, 1, 5.0)]
    batch = stream.cell_counts(spark.createDataFrame(rows, kind)).agg(F.sum("n")).first()[0]
    assert batch == 4

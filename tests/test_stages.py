from pyspark.sql import functions as F

from velotrace.plans import stages
from velotrace.sources.pings import from_events

SF = "/root/testdata/sf0.001"


def test_days_run_skip_and_fail(spark, tmp_path):
    pings = from_events(spark.read.parquet(f"{SF}/events.parquet"))
    days = {"2017-03-01": pings.where("day % 2 = 0"), "2017-03-02": pings.where("day % 2 = 1")}
    root = str(tmp_path / "run")
    assert {r.status for r in stages.run_days(spark, days, root, execute=False)} == {"SKIPPED"}
    assert not (tmp_path / "run").exists()
    first = stages.run_days(spark, days, root)
    assert [r.status for r in first] == ["SUCCESS"] * 6 and all(r.metrics["rows"] >= 0 for r in first)
    assert {r.status for r in stages.run_days(spark, days, root)} == {"SKIPPED"}
    bad = stages.run_days(spark, {"2017-03-03": pings.drop("speed")}, root)
    assert [r.status for r in bad] == ["FAILED"] and "lacks ['speed']" in bad[0].error


def test_day_starts_at_local_midnight():
    assert stages.day_start("2017-03-01") == 1488297600


def test_out_of_day_follows_the_day(spark):
    d = from_events(spark.read.parquet(f"{SF}/events.parquet"))
    f = stages.features(d, stages.DEFAULT, "2017-03-01")
    assert f.agg(F.max("out_of_day")).first()[0] == 0

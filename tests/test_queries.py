"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from velotrace.plans import registry
from velotrace.plans.trajectory import GATED

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    places = [want.columns.index(c) for c in columns]
    b = sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_every_ping_is_snapped(spark, duck):
    """None is left out by its number."""
    got = registry.QUERIES["J9_snapped"](spark, SF)
    near = duck.sql(registry.ORACLES["J9_snapped"]).fetchall()
    assert got.where("src_seq % 10 <> 0").count() == sum(i % 10 != 0 for i, _ in near) > 0
    assert got.count() == len(near)



def test_points_on_an_edge_of_hexagons(spark, tmp_path):
    """Where x is 0 two roundings are equally far, and the last bit decides as it does in the SQL."""
    ids = [101482, 111455, 201212, 211185, 320888, *range(101482 % 9973, 6_000_000, 9973)]
    duckdb.sql(f"copy (select unnest({ids})::BIGINT as event_id) to '{tmp_path}/events.parquet'")
    got = registry.QUERIES["SP5_axial"](spark, str(tmp_path)).collect()
    want = duckdb.sql(registry.ORACLES["SP5_axial"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_trip_that_ends_where_it_began_is_exported(spark, tmp_path):
    """It has no path, but lies in the area."""
    c, at = duckdb.connect(), f"{tmp_path}/events.parquet"
    c.sql("create view events as select * from '/root/testdata/sf0.1/events.parquet'")
    c.sql(f"copy (select * from events where cast(user_id as varchar) in ({GATED} select taxi_id from numbered where olon = dlon and olat = dlat)) to '{at}'")
    c.sql(f"create or replace view events as select * from '{at}'")
    want = c.sql(registry.ORACLES["R7_final_export"]).fetchall()
    assert c.sql(f"{GATED} select count(*) from numbered where olon = dlon and olat = dlat").fetchall()[0][0] > 0
    assert [tuple(r) for r in registry.QUERIES["R7_final_export"](spark, str(tmp_path)).collect()] == want

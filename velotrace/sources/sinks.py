"""Sinks: nothing is overwritten in place."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """UTF-8 with a header and, as spreadsheets ask for it, a byte order mark before it; fails if the path is there."""
    first = df.columns[0]
    d = df.withColumnRenamed(first, BOM + first) if mark else df
    d.write.mode("errorifexists").option("header", True).option("encoding", "UTF-8").csv(path)


def checked(df: DataFrame, write, rows) -> int:
    """Writes df by write(df) and holds the rows it had against what rows() counts more than before; the number of rows."""
    before, seen = rows(), Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n, after = seen.get["n"], rows()
    if after - before != n:
        raise RuntimeError(f"{n} rows were written, {after - before} are there")
    return n


def write_parts(df: DataFrame, path: str, rows: int = 2_000_000) -> None:
    """No file holds more rows than that."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows).parquet(path)


def wkt_line(points: Column) -> Column:
    """A LINESTRING of an array of (x, y); null for fewer than two points."""
    pair = F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.when(F.size(points) >= 2, F.concat(F.lit("LINESTRING ("), F.array_join(pair, ", "), F.lit(")")))


def geojson_features(df: DataFrame, points: str, kind: str = "LineString") -> DataFrame:
    """One GeoJSON feature a row in the column feature."""
    rest = [c for c in df.columns if c != points]
    coordinates = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def write_geojson(df: DataFrame, points: str, path: str, append: bool = False) -> int:
    """Newline-delimited features, a new table or more rows of one; the number of rows, checked by reading them."""
    return _write(geojson_features(df, points), path, append, "text")


def _write(df: DataFrame, path: str, append: bool, kind: str, **options: str) -> int:
    spark = df.sparkSession
    at, fs = _path(spark, path)
    if fs.exists(at) and not append:
        raise FileExistsError(path)
    rows = lambda: spark.read.format(kind).options(**options).load(path).count() if fs.exists(at) else 0
    return checked(df, lambda d: d.write.mode("append").format(kind).options(**options).save(path), rows)


def write_vector(df: DataFrame, points: str, path: str, append: bool = False) -> int:
    """Lines in the format that the path's ending names: GeoJSON (geojson, json), WKT in CSV (csv), or points in
    Parquet (parquet). The number of rows, checked by reading them."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("geojson", "json"):
        return write_geojson(df, points, path, append)
    if kind == "csv":
        return _write(df.withColumn("wkt", wkt_line(F.col(points))).drop(points), path, append, "csv", header="true", escape='"')
    if kind == "parquet":
        return _write(df, path, append, "parquet")
    raise ValueError(f"no format for {path}; there are geojson, json, csv and parquet")


def write_raster(cells: DataFrame, spec: dict, path: str) -> None:
    """Cells (label, row, col, value) and beside them the grid they lie on."""
    cells.write.mode("errorifexists").partitionBy("label").parquet(f"{path}/cells")
    write_json(cells.sparkSession, spec, f"{path}/grid")


def read_raster(spark: SparkSession, path: str, spec: dict | None = None) -> DataFrame:
    """Cells of a raster; with spec, an error unless they lie on that grid."""
    found = read_json(spark, f"{path}/grid")
    if spec is not None and found != spec:
        raise ValueError(f"grids differ: {found} and {spec}")
    return spark.read.parquet(f"{path}/cells")


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_json(spark: SparkSession, summary: dict, path: str) -> None:
    """One line of JSON."""
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def replace(df: DataFrame, path: str) -> None:
    """Written beside the old data and then put in its place; the old data stay aside until the new are there, and
    are put back if the session ended in between."""
    spark = df.sparkSession
    (at, fs), (new, _), (old, _) = (_path(spark, f"{path}{x}") for x in ("", ".new", ".old"))
    if fs.exists(old) and not fs.exists(at):
        fs.rename(old, at)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old) or not fs.rename(new, at):
        raise RuntimeError(f"{path} can't be put in place; its data are in {path}.old and {path}.new")
    fs.delete(old, True)


def new_run(spark: SparkSession, root: str, run_id: str | None = None, execute: bool = True) -> str:
    """The folder of a run, named by time unless told, made only if the run is to be executed; an error if it is there."""
    path = f"{root}/{run_id or time.strftime('%Y%m%d_%H%M%S')}"
    at, fs = _path(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    if execute:
        fs.mkdirs(at)
    return path


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write came to its end; what one left half done is removed."""
    at, fs = _path(spark, path)
    mark, _ = _path(spark, f"{path}/_SUCCESS")
    if fs.exists(mark):
        return True
    fs.delete(at, True)
    return False

"""Sources of lines and polygons, as arrays of (x, y)."""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import day_of_file, route_id

POINTS = "array<struct<x:double,y:double>>"


def wkt_points(text: Column) -> Column:
    """The points of a LINESTRING, or of the outer ring of a POLYGON; null for other text."""
    inner = F.regexp_extract(text, r"^\s*(?i:LINESTRING|POLYGON)\s*[ZM]*\s*\(+\s*([^()]+?)\s*\)", 1)
    pairs = F.split(inner, r"\s*,\s*")
    points = F.transform(pairs, lambda p: F.struct(F.get(F.split(p, r"\s+"), 0).try_cast("double").alias("x"), F.get(F.split(p, r"\s+"), 1).try_cast("double").alias("y")))
    return F.when(inner != "", points)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines whose characters stand for the bytes of the files."""
    return spark.read.option("encoding", "ISO-8859-1").option("quote", "").option("sep", "\0").schema("value string").csv(path)


def charset_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line of the files is, else GB18030, which holds GBK."""
    line = F.encode(F.col("value"), "ISO-8859-1").cast("string")
    return "UTF-8" if _lines(spark, path).where(~F.is_valid_utf8(line)).isEmpty() else "GB18030"


def read_wkt(spark: SparkSession, path: str, column: str = "wkt", charset: str | None = None) -> DataFrame:
    """A CSV with a WKT column, read as points. Without a charset it is the first of UTF-8 and GB18030 that fits.

    Charsets that the engine doesn't read are decoded in Arrow batches; a line is then a row.
    """
    charset = charset or charset_of(spark, path)
    if charset.upper() in ("UTF-8", "ISO-8859-1", "US-ASCII"):
        d = spark.read.option("header", True).option("encoding", charset).option("escape", '"').csv(path)
        return d.withColumn("points", wkt_points(F.col(column))).drop(column)

    @F.arrow_udf("string")
    def decoded(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.encode("latin-1").decode(charset, "replace") for x in lines.to_pylist()], pa.string())

    lines = _lines(spark, path)
    header = lines.first()[0]
    names = next(csv.reader([header.encode("latin-1").decode(charset)]))
    row = F.from_csv(decoded(F.col("value")), ", ".join(f"`{n}` string" for n in names), {"escape": '"'})
    d = lines.where(F.col("value") != header).select(row.alias("_row")).select("_row.*")
    return d.withColumn("points", wkt_points(F.col(column))).drop(column)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited features with line geometries: properties (as a map) and points."""
    schema = "type string, properties map<string,string>, geometry struct<type:string,coordinates:array<array<double>>>"
    d = spark.read.schema(schema).json(path)
    return d.select("properties", F.transform("geometry.coordinates", lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("points"))


def read_days(spark: SparkSession, pattern: str, year: int = 2017) -> DataFrame:
    """Files of several days, or folders of such; each row gets the day of its file's or folder's name and a route id."""
    part = lambda n: day_of_file(F.element_at(F.split(F.input_file_name(), "/"), -n), year)
    day = F.when(F.element_at(F.split(F.input_file_name(), "/"), -1).startswith("part-"), part(2)).otherwise(part(1))
    d = spark.read.parquet(pattern).withColumn("trip_date", day)
    return d.withColumn("route_id", route_id(F.col("trip_date"), F.col("trip_id")))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every Parquet file below the path."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)

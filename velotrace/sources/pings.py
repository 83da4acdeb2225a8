"""Sources of pings.

The core columns are group_id, taxi_id, timestamp, speed, latitude, longitude, direction, positioning_valid, occupied;
src_seq tells rows of one vehicle and second apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_number

#: Words of the raw status that mean a valid position and an occupied vehicle. Fixed values of the raw format.
VALID, OCCUPIED = "定位有效", "重车"
RAW_FIELDS = 13

CORE = T.StructType(
    [
        T.StructField("group_id", T.StringType()),
        T.StructField("taxi_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("speed", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("direction", T.DoubleType()),
        T.StructField("positioning_valid", T.IntegerType()),
        T.StructField("occupied", T.IntegerType()),
    ]
)


def raw_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Core rows of tab-separated lines; lines that aren't one have ok = false and are kept to be counted."""
    f = F.split(F.col(column), "\t", -1)
    part: list[Column] = [F.get(f, i) for i in range(RAW_FIELDS)]
    whole = r"^\s*[+-]?\d+\s*$"
    ok = (F.size(f) == RAW_FIELDS) & part[2].rlike(whole) & parse_number(part[4]).isNotNull() & parse_number(part[5]).isNotNull()
    return lines.select(
        F.coalesce(ok, F.lit(False)).alias("ok"),
        part[0].alias("group_id"),
        part[1].alias("taxi_id"),
        F.trim(part[2]).try_cast("long").alias("timestamp"),
        part[3].alias("speed"),
        (parse_number(part[4]) / 100000.0).alias("latitude"),
        (parse_number(part[5]) / 100000.0).alias("longitude"),
        parse_number(part[6]).alias("direction"),
        part[12].contains(VALID).cast("int").alias("positioning_valid"),
        part[12].contains(OCCUPIED).cast("int").alias("occupied"),
    )


def read_raw(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Valid rows of raw files; a limit counts valid rows."""
    rows = raw_lines(spark.read.text(path)).where("ok").drop("ok")
    return rows.limit(limit) if limit is not None else rows


#: Stands for a field that isn't there, where an empty one is.
ABSENT = "\0absent"
#: Columns without which a row of pings is none; a bad direction or speed alone is null and keeps the row.
REQUIRED = ("timestamp", "latitude", "longitude")


def typed(text: DataFrame, schema: T.StructType, required: tuple[str, ...]) -> DataFrame:
    """Text columns in the types of a schema, what can't be read being null; rows whose required columns, or last column,
    are missing or can't be read are dropped, whatever is selected afterwards."""
    kinds = {f.name: f.dataType for f in schema.fields}

    def value(name: str) -> Column:
        kind = kinds[name]
        if isinstance(kind, T.StringType):
            return F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return parse_number(F.col(name)).cast(kind)
        return F.when(F.col(name).rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.regexp_replace(F.trim(name), r"\.0*$", "").try_cast(kind))

    fine = F.col(schema.names[-1]).isNotNull()
    for name in required:
        fine = fine & value(name).isNotNull()
    return text.where(F.coalesce(fine, F.lit(False))).select(*[value(n).alias(n) for n in schema.names])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = CORE, header: bool = True, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """S3: the columns of a schema, by the names of the header, or by place without one; typed, and pruned by what is
    selected. A file that lacks a column is an error that tells which."""
    reader = spark.read.option("header", header).option("nullValue", ABSENT)
    if not header:
        return typed(reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in schema.names])).csv(path), schema, required)
    d = reader.csv(path)
    missing = [n for n in schema.names if n not in d.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}; it has {d.columns}")
    return typed(d.select(*schema.names), schema, required)


def read_positional(spark: SparkSession, path: str, schema: T.StructType = CORE, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Lines that have exactly as many fields as the schema, by place; a header is a line that can't be read."""
    names = [*schema.names, "_more"]
    kind = ", ".join(f"`{n}` string" for n in names)
    line = F.from_csv(F.col("value"), kind, {"nullValue": ABSENT})
    d = spark.read.text(path).select(line.alias("f")).where("f._more is null").select("f.*").drop("_more")
    return typed(d, schema, required)


def ordered(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Each vehicle's rows in one partition, in order of time; ties keep the order of src_seq."""
    d = df.withColumn("timestamp", F.col("timestamp").cast("long"))
    return (d.repartition(parts, "taxi_id") if parts else d.repartition("taxi_id")).sortWithinPartitions("taxi_id", "timestamp", "src_seq")


def from_events(events: DataFrame) -> DataFrame:
    """Pings of the events table: 30 days become six hours of a morning, places a box of two kilometres."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        (F.col("user_id") % 7).cast("string").alias("group_id"),
        F.col("user_id").cast("string").alias("taxi_id"),
        (F.lit(1488319200) + F.floor((seconds - 1704067200) / 120)).cast("long").alias("timestamp"),
        F.col("value").cast("double").alias("speed"),
        (F.lit(39.90) + ((F.col("event_id") * 104729) % 2001 - 1000) * 1e-5).alias("latitude"),
        (F.lit(116.40) + ((F.col("event_id") * 7919) % 2001 - 1000) * 1e-5).alias("longitude"),
        (k * 3.6).alias("direction"),
        F.lit(1).alias("positioning_valid"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("occupied"),
        F.col("event_id").alias("src_seq"),
        F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"),
    )


#: The same in SQL.
FROM_EVENTS_SQL = """
  SELECT CAST(user_id % 7 AS VARCHAR) AS group_id, CAST(user_id AS VARCHAR) AS taxi_id,
    CAST(1488319200 + (epoch_us(ts) // 1000000 - 1704067200) // 120 AS BIGINT) AS timestamp, CAST(value AS DOUBLE) AS speed,
    39.90 + ((event_id * 104729) % 2001 - 1000) * CAST(1e-5 AS DOUBLE) AS latitude, 116.40 + ((event_id * 7919) % 2001 - 1000) * CAST(1e-5 AS DOUBLE) AS longitude,
    CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) * CAST(3.6 AS DOUBLE) AS direction, 1 AS positioning_valid,
    CAST(event_type IN ('click', 'purchase') AS INTEGER) AS occupied, event_id AS src_seq, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day
  FROM events
"""

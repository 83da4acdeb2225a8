"""What several corpus operators share: shared folders, gapless ranks, components, ragged arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import discard, fresh_path, shared_dir, written  # noqa: F401

#: Rows that go to a Python worker at a time.
BATCH_ROWS = 1000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it was found by the driver's path alone, and bounds their batches.

    Rows here hold whole documents, so the default of ten thousand rows a batch would be tens of megabytes many times.
    """
    env = spark.sparkContext.environment
    # workers give memory back to the machine: one arena, and Arrow's buffers from it too; one thread each, as tasks are many
    for name, value in (("MALLOC_ARENA_MAX", "1"), ("ARROW_DEFAULT_MEMORY_POOL", "system"), ("OPENBLAS_NUM_THREADS", "1")):
        env.setdefault(name, value)
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [have, ROOT]))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


_held: dict = {}


def held(key, make):
    """What a worker keeps between tasks: the tables and caches of one operator at a time, so that workers stay small."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Returns a worker's free memory to the machine, as an idle worker stays for a while."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def gapless_rank(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], into: str, weight: str | None = None) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, by (bucket, order); with a weight, a row stands for so many.

    A group is never sorted as a whole: each bucket is numbered alone and starts at the count of the buckets before
    it, so a group that holds a third of all rows is spread over as many tasks as it has buckets. groups and bucket
    must not be null. df is computed twice; give it a cheap or written one.
    """
    d = df.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    count = d.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_count"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = count.select(*keys, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    base = base.repartition(*keys)  # else the rows would be dealt by the groups alone, as the window above is
    inside = Window.partitionBy(*keys).orderBy(*order)
    rank = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(inside) - 1
    return d.join(base, keys).withColumn(into, F.col("_base") + rank).drop("_bucket", "_base")


#: Numbers that are written out in one go.
RUN = 10_000


def gapless_copies(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], into: str) -> DataFrame:
    """gapless_rank for rows that may be there any number of times: equal ones are counted before anything is dealt out
    and get a run of numbers, so neither a bucket nor a task is filled by a row that is there very often.

    bucket and order are of columns of df; the order must tell different rows apart.
    """
    counted = written(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")), "counted")
    ranked = gapless_rank(counted, groups, bucket, order, "_first", "_copies")
    # a run is written out in steps, so that a long one is dealt out too
    runs = ranked.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(RUN).cast("long"))))
    if not counted.where(F.col("_copies") > RUN).isEmpty():
        runs = runs.repartition(F.col("_first") + F.col("_step"))
    begin, end = F.col("_first") + F.col("_step"), F.col("_first") + F.least(F.col("_copies"), F.col("_step") + RUN) - 1
    return runs.select(*df.columns, F.explode(F.sequence(begin, end)).alias(into))


def md5_bucket(value: Column, digits: int = 3) -> Column:
    """0 to 16 ** digits - 1 from the md5 of the value as text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, digits), 16, 10).cast("int")


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Where each piece starts, and at the end the whole length."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[s : s + n] one after another."""
    lengths = lengths.astype(np.int64, copy=False)
    at = offsets(lengths)
    index = np.arange(at[-1], dtype=np.int64)
    index += np.repeat(starts.astype(np.int64, copy=False) - at[:-1], lengths)
    return flat[index]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u long, v long, both directions not needed): (node, root) with the smallest node.

    Alternating large-star and small-star steps; each step is two aggregations and joins on the node, never a list of
    a node's neighbours, so a node with very many neighbours is joined in parts. Each round is written to the shared
    folder. Nodes without an edge to another node don't appear.
    """
    e = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m", "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        e = written(small.where("u != v").distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

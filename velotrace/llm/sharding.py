"""Jump consistent hashing: keys to shards without a ring table.

A shard follows from the key and the number of shards alone. With one more shard, a key either stays or moves into the
new shard, and only the necessary fraction moves (Lamping and Veach, "A fast, minimal memory, consistent hash").
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import gapless_copies, md5_bucket, ship

LAW = "key"
#: Added to the UTF-8 bytes of a text for its record's size.
RECORD_OVERHEAD = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, all keys in step."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), np.int64)
    at, live = np.zeros(len(key), np.int64), np.arange(len(key))
    while len(live):
        out[live] = at
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        at = ((out[live] + 1) * (2147483648.0 / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        keep = at < shards
        live, key, at = live[keep], key[keep], at[keep]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key."""

    @pandas_udf("int")
    def of(k):
        return __import__("pandas").Series(jump(k.to_numpy(np.int64, na_value=0).view(np.uint64), shards).astype(np.int32))

    return of(F.coalesce(key, F.lit(0)))


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of df without the text, with size, text_crc32, law, shard, slot and grown_shard.

    A key that isn't a whole number is hashed first. Null keys count as key 0; rows that share a key share a shard. A
    null text has the size of the overhead and the checksum of an empty text. Slots are gapless in each shard, by
    bucket, key, checksum, size. Other columns are left out, so their names can't clash. An empty table gives no rows.

    Rows that are equal in all that is returned are counted before anything is dealt out and get a run of slots, so
    neither a key nor a row that is there very often fills a task.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]
    k = F.col(key).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("id"),
        k.alias("key"),
        (F.octet_length(body).cast("long") + RECORD_OVERHEAD).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumns({"shard": shard_of(F.col("key"), shards), "grown_shard": shard_of(F.col("key"), shards + 1)})
    bucket = md5_bucket(F.concat_ws(":", F.coalesce(F.col("key"), F.lit(0)), "text_crc32", "size"))
    ranked = gapless_copies(rows, ["shard"], bucket, [F.col(c) for c in ("key", "text_crc32", "size", "id")], "slot")
    return ranked.select(F.col("id").alias(key), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the rows of df as one folder a shard; files of a shard are split by size, not by shard. Keys must be unique."""
    out = df.join(assigned.select(key, "shard", "slot"), key)
    out.write.partitionBy("shard").option("maxRecordsPerFile", 500_000).parquet(path)

"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a single
    machine, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="velotrace-")  # one machine: a folder of its own is shared
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/velotrace/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


_at: dict = {}


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends there and a lost executor costs no rerun."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _at[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, so that a long session doesn't keep them all."""
    for t in tables:
        seen, path = _at.pop(id(t), (None, None))
        if seen is None or seen() is not t:
            continue
        spark = t.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

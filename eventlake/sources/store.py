"""Tables that driver and executors share: intermediate ones, and the stored record table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import PROMOTED, RECORD_SCHEMA


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and the master is local, a temporary one that goes with
    the process; on a cluster that would be another folder on each machine, so
    it is an error.  Folders below a named one stay until its owner clears them.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
    made = tempfile.mkdtemp(prefix="eventlake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: later reads take the columns they need, and lost executors cost nothing before it."""
    at = new_path(df.sparkSession, "stored")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def open_table(spark: SparkSession, path: str, promoted: list[str] | None = None) -> DataFrame:
    """The record table that ``writer.write`` wrote: partitions by namespace and shard, gids that rise in each file.

    Filters on gid, seq, event_type, shard, namespace and ``promoted`` metadata
    keys reach the scan; the schema is given, so no file is opened to infer it.
    """
    if not exists(spark, path):  # nothing was appended yet
        return spark.createDataFrame([], RECORD_SCHEMA)
    schema = T.StructType([*RECORD_SCHEMA.fields, *[T.StructField(PROMOTED + k, T.StringType()) for k in promoted or []]])
    return spark.read.schema(schema).parquet(path).select(*schema.names)

"""Appends: validation, sequence numbers, routing, one job for a batch."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checksum import crc32c
from ..functions.ids import encode_gid, gid_local
from ..functions.names import rejection
from ..schema import COLUMNS, CONTENT_BYTES, DEFAULT_CONTENT_TYPE, MARKER, PROMOTED, STREAM
from .live import live
from .ranges import number_rows
from .retention import quota_check, quota_usage


def split_valid(incoming: DataFrame, content_bytes: int = CONTENT_BYTES, names: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows in quarantine with ``rejected``: why)."""
    judged = incoming.withColumn("rejected", rejection(content_bytes, names))
    return judged.where("rejected IS NULL").drop("rejected"), judged.where("rejected IS NOT NULL")


def with_defaults(incoming: DataFrame, now: datetime.datetime | None = None) -> DataFrame:
    """content_type and timestamp_ns where they are missing (0 counts as missing)."""
    stamp = int((now or datetime.datetime.now(datetime.timezone.utc)).timestamp() * 1e6) * 1000
    return incoming.withColumns(
        {
            "content_type": F.when(F.coalesce("content_type", F.lit("")) == "", DEFAULT_CONTENT_TYPE).otherwise(F.col("content_type")),
            "timestamp_ns": F.when(F.coalesce("timestamp_ns", F.lit(0)) == 0, F.lit(stamp)).otherwise(F.col("timestamp_ns")),
        }
    )


def assign_seq(incoming: DataFrame, records: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Incoming rows with seq: after each stream's last one, from 1, by ``arrival``; a stream of very many rows is numbered in ranges."""
    last = records.groupBy(*STREAM).agg(F.max("seq").alias("__last"))
    return number_rows(incoming, arrival, STREAM, column="__n", ties=_told(incoming)).join(last, STREAM, "left").withColumn("seq", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long")).drop("__n", "__last")


def assign_seq_single(incoming: DataFrame, last: int, arrival: str = "arrival") -> DataFrame:
    """The same for one huge stream: numbers from ranges of arrivals and their sizes, not from one task."""
    return number_rows(incoming, arrival, ties=_told(incoming)).withColumn("seq", F.col("pos") + last).drop("pos")


def _told(incoming: DataFrame) -> list[str]:
    """Columns that tell rows of one arrival apart, so that their numbers are the same however often they are given."""
    return [c for c in ("event_type", "timestamp_ns", "content") if c in incoming.columns]


def route(incoming: DataFrame, shards: int, key: str | None = None) -> DataFrame:
    """Incoming rows with shard_id: by the key's CRC-32C, the same in every process; without a key by the row's name and number."""
    where = crc32c(F.col(key)) if key else F.xxhash64(*STREAM, "seq")
    return incoming.withColumn("shard_id", F.pmod(where, F.lit(shards)).cast("int"))


def assign_gid(routed: DataFrame, records: DataFrame, shards: int, arrival: str = "arrival") -> DataFrame:
    """Routed rows with gid: local numbers go on after each shard's last one, by ``arrival``; a shard is numbered in ranges."""
    last = records.groupBy("shard_id").agg(F.max(gid_local(F.col("gid"), shards)).alias("__last"))
    local = F.coalesce("__last", F.lit(-1)) + F.col("__n")
    numbered = number_rows(routed, arrival, ["shard_id"], column="__n", ties=[*STREAM, "seq"])
    return numbered.join(last, "shard_id", "left").withColumn("gid", encode_gid(local, F.col("shard_id"), shards)).drop("__n", "__last")


def promote(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records with a column for each of the metadata keys, so that predicates on them are pushed to the scan."""
    return records.withColumns({PROMOTED + k: F.col("metadata")[k] for k in keys})


def append(incoming: DataFrame, records: DataFrame, shards: int, key: str | None = None, arrival: str = "arrival") -> DataFrame:
    """Incoming rows as records, complete but for a hash chain; writing them is one job, which is what makes a batch atomic."""
    rows = assign_gid(route(assign_seq(with_defaults(incoming), records, arrival), shards, key), records, shards, arrival)
    kept = [c for c in COLUMNS if c in rows.columns]
    return rows.select(*kept)


def batch_append(incoming: DataFrame, records: DataFrame, shards: int, quotas: DataFrame | None = None, **options) -> DataFrame:
    """append() for rows of one stream: refused as a whole if they name more than one, or would exceed the quota; no rows give no rows."""
    streams = incoming.select(*STREAM).distinct().limit(2).collect()
    if len(streams) > 1:
        raise ValueError("a batch is of one stream")
    if quotas is not None and streams:
        size = incoming.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("add_records"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).alias("add_bytes"))
        if not quota_check(quota_usage(records), size, quotas).first().accepted:
            raise PermissionError("the batch exceeds the stream's quota")
    return append(incoming, records, shards, **options)


def delete_stream(records: DataFrame, namespace: str, stream: str, shards: int, marker: str = MARKER) -> DataFrame:
    """The marker to append, which deletes all of the stream so far; :func:`live_count` before it is what it deletes."""
    spark = records.sparkSession
    row = spark.createDataFrame(
        [(namespace, stream, marker, 1)], "namespace string, stream string, event_type string, arrival long"
    ).withColumns({"content_type": F.lit(None).cast("string"), "timestamp_ns": F.lit(0).cast("long"), "metadata": F.create_map().cast("map<string,string>"), "content": F.lit(b"")})
    return append(row, records, shards)


def live_count(records: DataFrame, namespace: str, stream: str, marker: str = MARKER) -> DataFrame:
    """(n): how many live records a marker appended now would delete."""
    of = records.where((F.col("namespace") == namespace) & (F.col("stream") == stream))
    return live(of, marker=marker).agg(F.count(F.lit(1)).alias("n"))


def write(rows: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Append records to a table of Parquet files by namespace and shard, sorted by gid, so that gid ranges skip files and row groups.

    A shard is written by as many tasks as its size asks for, each with a range of its gids.
    """
    place = ["namespace", "shard_id", "gid"]
    # A name that is neither null nor a constant: for either Spark would sort by partition columns once more, without the gid.
    rows = rows.withColumn("namespace", F.coalesce(F.when(F.col("gid").isNotNull(), F.col("namespace")), F.lit("")))
    out = rows.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("append").option("compression", "zstd")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    out.partitionBy("namespace", "shard_id").parquet(path)

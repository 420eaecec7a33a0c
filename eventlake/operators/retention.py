"""Retention, truncation, quotas: what may go and what may come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MARKER, STREAM
from .live import live


def retain_max_bytes(segments: DataFrame, max_bytes: int) -> DataFrame:
    """Segments to delete, (shard_id, segment_id): the oldest first, until a shard's total is no more than ``max_bytes``; the last one stays.

    ``segments``: (shard_id, segment_id, bytes).  A segment goes if what is left without those before it is still too much.
    """
    by = Window.partitionBy("shard_id")
    after = F.sum("bytes").over(by.orderBy(F.col("segment_id").desc()))
    return (
        segments.withColumn("remaining", after)
        .withColumn("active", F.max("segment_id").over(by))
        .where((F.col("segment_id") < F.col("active")) & (F.col("remaining") > max_bytes))
        .select("shard_id", "segment_id")
    )


def retain_max_age(segments: DataFrame, now_ns: int, max_age_ns: int) -> DataFrame:
    """Segments to delete: written (modified_ns) at least ``max_age_ns`` ago; the last one of a shard stays."""
    active = F.max("segment_id").over(Window.partitionBy("shard_id"))
    return (
        segments.withColumn("active", active)
        .where((F.col("segment_id") < F.col("active")) & (F.lit(now_ns) - F.col("modified_ns") >= max_age_ns))
        .select("shard_id", "segment_id")
    )


def truncate_before(segments: DataFrame, checkpoint: int) -> DataFrame:
    """Segments to delete: those whose next segment begins at or before the checkpoint, for then all of their records are below it."""
    following = F.lead("base_seq").over(Window.partitionBy("shard_id").orderBy("segment_id"))
    return segments.withColumn("following", following).where(F.col("following") <= checkpoint).select("shard_id", "segment_id")


def quota_usage(records: DataFrame, marker: str = MARKER) -> DataFrame:
    """(namespace, stream, n_records, n_bytes) of live records; markers don't count."""
    kept = live(records.select(*STREAM, "seq", "event_type", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size")), marker=marker)
    return kept.where(F.col("event_type") != marker).groupBy(*STREAM).agg(F.count(F.lit(1)).alias("n_records"), F.sum("size").cast("long").alias("n_bytes"))


def quota_check(usage: DataFrame, incoming: DataFrame, quotas: DataFrame) -> DataFrame:
    """Incoming batches with ``accepted``: usage and batch together within the quota.

    ``incoming``: (namespace, stream, add_records, add_bytes); ``quotas``: (namespace, stream, max_records, max_bytes), null or 0 for none.
    """
    joined = incoming.join(usage, STREAM, "left").join(quotas, STREAM, "left")
    over = lambda used, add, most: (F.coalesce(F.col(most), F.lit(0)) > 0) & (F.coalesce(F.col(used), F.lit(0)) + F.col(add) > F.col(most))
    reject = over("n_records", "add_records", "max_records") | over("n_bytes", "add_bytes", "max_bytes")
    return joined.select(*incoming.columns, (~reject).alias("accepted"))


def wal_usage(segments: DataFrame) -> DataFrame:
    """(shard_id, n_segments, n_bytes)."""
    return segments.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("bytes").cast("long").alias("n_bytes"))


def segments_of(records: DataFrame, rows: int) -> DataFrame:
    """Segments as a log of ``rows`` records each would have: (shard_id, segment_id from 1, base_seq, bytes, modified_ns); local_seq numbers a shard's records."""
    number = F.floor(F.col("local_seq") / rows).cast("long") + 1
    return records.groupBy("shard_id", number.alias("segment_id")).agg(
        F.min("gid").alias("base_seq"),
        F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).cast("long").alias("bytes"),
        F.max("timestamp_ns").alias("modified_ns"),
    )

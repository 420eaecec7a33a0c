"""Namespaces, streams, cursors and recovery, derived from the records themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import encode_gid, gid_local, shard_bits
from ..schema import STREAM


def name_ids(records: DataFrame) -> DataFrame:
    """(namespace, stream, namespace_id, stream_id): ids that the records carry; reading creates no stream."""
    return records.select(*STREAM, "namespace_id", "stream_id").distinct()


def resolve(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests by name with their ids; unknown names have null ids."""
    return requests.join(catalog, STREAM, "left")


def list_namespaces(records: DataFrame) -> DataFrame:
    """(namespace, n_streams) but for hidden ones, whose names begin with _."""
    seen = records.where(~F.col("namespace").startswith("_")).select(*STREAM).distinct()
    return seen.groupBy("namespace").agg(F.count("stream").alias("n_streams"))


def list_streams(records: DataFrame) -> DataFrame:
    """(namespace, stream, first_seq, last_seq, n_records)."""
    return records.groupBy(*STREAM).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_records"))


def next_seq(records: DataFrame) -> DataFrame:
    """(namespace, stream, next_seq)."""
    return records.groupBy(*STREAM).agg((F.max("seq") + 1).alias("next_seq"))


def seq_index(records: DataFrame) -> DataFrame:
    """(namespace, stream, seq, gid): where each record of a stream is."""
    return records.select(*STREAM, "seq", "gid")


def shard_cursors(records: DataFrame, shards: int) -> DataFrame:
    """(shard_id, cursor): a shard's first local number that is not there yet."""
    return records.groupBy("shard_id").agg((F.max(gid_local(F.col("gid"), shards)) + 1).alias("cursor"))


def _all_cursors(records: DataFrame, shards: int) -> DataFrame:
    every = records.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard_id"))
    return every.join(shard_cursors(records, shards), "shard_id", "left").select("shard_id", F.coalesce("cursor", F.lit(0)).alias("cursor"))


def watermark(records: DataFrame, shards: int) -> DataFrame:
    """(oldest_seq, newest_seq, min_cursor, max_cursor): positions of the log; shards without records count as at 0."""
    cursors = _all_cursors(records, shards).agg(F.min("cursor").alias("min_cursor"), F.max("cursor").alias("max_cursor"))
    ends = records.agg(F.coalesce(F.min("seq"), F.lit(0)).alias("oldest_seq"), F.coalesce(F.max("seq"), F.lit(0)).alias("newest_seq"))
    return ends.withColumn("k", F.lit(1)).join(cursors.withColumn("k", F.lit(1)), "k").drop("k")


def recovery_report(records: DataFrame, shards: int, checkpoint: int) -> DataFrame:
    """(from_sequence, to_sequence, n_records): what a replay from the checkpoint (a gid) would read.

    n_records sums over shards the records whose gid is not below the
    checkpoint; to_sequence is the smallest gid that is not there yet.
    """
    stride = 1 << shard_bits(shards)
    first = F.greatest(F.lit(0), F.ceil((F.lit(checkpoint) - F.col("shard_id")) / stride)).cast("long")
    return _all_cursors(records, shards).agg(
        F.lit(checkpoint).cast("long").alias("from_sequence"),
        F.min(encode_gid(F.col("cursor"), F.col("shard_id"), shards)).alias("to_sequence"),
        F.sum(F.greatest(F.lit(0), F.col("cursor") - first)).cast("long").alias("n_records"),
    )


def kv_replay(records: DataFrame, text: str = "text") -> DataFrame:
    """(key, value) after replaying ``PUT key value`` and ``DEL key`` lines by seq: the last line of a key wins, a deleted key is gone."""
    parts = F.split(F.col(text), " ", 3)
    ops = records.select(F.get(parts, F.lit(0)).alias("op"), F.get(parts, F.lit(1)).alias("key"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("value"), "seq")
    last = ops.where(F.col("op").isin("PUT", "DEL") & F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.where("last.op = 'PUT'").select("key", F.col("last.value").alias("value"))

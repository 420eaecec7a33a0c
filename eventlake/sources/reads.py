"""Reads of a record table: points, ranges, shards, pages, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import gid_local
from ..operators.ranges import number_rows
from ..schema import PAGE_ROWS, STREAM

#: Most gids that are sent to all executors (8 MB).
SENT = 1_000_000


def read_gid(records: DataFrame, gid: int) -> DataFrame:
    return records.where(F.col("gid") == gid)


def read_seq(live: DataFrame, namespace: str, stream: str, seq: int) -> DataFrame:
    """One record of a stream's live view; none if it is tombstoned."""
    return live.where((F.col("namespace") == namespace) & (F.col("stream") == stream) & (F.col("seq") == seq))


def multi_get(records: DataFrame, gids: list[int]) -> DataFrame:
    """A row for each asked gid, in order, with ``pos`` from 0 and ``found``; repeats are kept, misses have nulls.

    The list comes from the caller, so its size is known: the scan is cut to its
    span and, up to SENT gids, sifted by the list itself before anything moves.
    """
    asked = records.sparkSession.createDataFrame([(i, g) for i, g in enumerate(gids)], "pos long, asked long")
    if not gids:
        return asked.join(records.withColumn("found", F.lit(True)).limit(0), F.col("asked") == F.col("gid"), "left")
    within = records.where((F.col("gid") >= min(gids)) & (F.col("gid") <= max(gids))).withColumn("found", F.lit(True))
    if len(gids) <= SENT:
        names = records.sparkSession.createDataFrame([(g,) for g in set(gids)], "__gid long")
        within = within.join(F.broadcast(names), F.col("gid") == F.col("__gid"), "left_semi")
    return asked.join(within, F.col("asked") == F.col("gid"), "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("pos")


def scan(records: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Records of gids from ``start`` up to but not including ``stop``, ascending, shards merged."""
    out = records
    if start is not None:
        out = out.where(F.col("gid") >= start)
    if stop is not None:
        out = out.where(F.col("gid") < stop)
    return out.orderBy("gid")


def scan_shard(records: DataFrame, shard: int, start: int | None = None, stop: int | None = None) -> DataFrame:
    return scan(records.where(F.col("shard_id") == shard), start, stop)


def replay_from(records: DataFrame, gid: int) -> DataFrame:
    return scan(records, gid)


def scan_stream(records: DataFrame, namespace: str, stream: str, from_seq: int = 0, shards: list[int] | None = None, limit: int = 0) -> DataFrame:
    """A stream's records from ``from_seq`` on, by seq; no shards named means all, limit 0 means all."""
    out = records.where((F.col("namespace") == namespace) & (F.col("stream") == stream) & (F.col("seq") >= from_seq))
    if shards:
        out = out.where(F.col("shard_id").isin(*shards))
    out = out.orderBy("seq")
    return out.limit(limit) if limit > 0 else out


def scan_pages(live: DataFrame, from_seq: int = 0, page_rows: int = 0) -> DataFrame:
    """The scan's records with page (from 0), next_seq of the page and has_more.

    ``page_rows`` is the size of a page and no cap; 0 is the default size.
    """
    size = page_rows if page_rows > 0 else PAGE_ROWS
    rows = number_rows(live.where(F.col("seq") >= from_seq), "seq")
    paged = rows.withColumn("page", F.floor((F.col("pos") - 1) / size).cast("long")).drop("pos")
    ends = paged.groupBy("page").agg((F.max("seq") + 1).alias("next_seq"))
    last = ends.agg(F.max("page").alias("last")).withColumn("k", F.lit(1))
    ends = ends.withColumn("k", F.lit(1)).join(F.broadcast(last), "k").select("page", "next_seq", (F.col("page") < F.col("last")).alias("has_more"))  # last is one row
    return paged.join(ends, "page")


def tailer_batch(records: DataFrame, positions: DataFrame, shards: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(batch, positions after it) of a tailer at ``positions`` (shard_id, position: the next local number).

    Up to ``most`` records, merged by gid; a shard's position moves to after the last record of it that was delivered.
    """
    local = records.withColumn("local_seq", gid_local(F.col("gid"), shards))
    due = local.join(positions, "shard_id").where(F.col("local_seq") >= F.col("position")).drop("position")
    batch = due.orderBy("gid").limit(most)
    moved = batch.groupBy("shard_id").agg((F.max("local_seq") + 1).alias("moved"))
    after = positions.join(moved, "shard_id", "left").select("shard_id", F.coalesce("moved", "position").alias("position"))
    return batch.drop("local_seq"), after


def tailer_position(positions: DataFrame) -> DataFrame:
    """(position): the least over shards."""
    return positions.agg(F.coalesce(F.min("position"), F.lit(0)).alias("position"))


def tailer_seek(positions: DataFrame, position: int) -> DataFrame:
    """All shards at ``position``; 0 starts over."""
    return positions.select("shard_id", F.lit(position).cast("long").alias("position"))


def latest_by_stream(records: DataFrame) -> DataFrame:
    """The last record of each stream."""
    last = F.row_number().over(Window.partitionBy(*STREAM).orderBy(F.col("seq").desc()))
    return records.withColumn("__n", last).where("__n = 1").drop("__n")

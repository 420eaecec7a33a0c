"""Exports: JSON lines, sinks with batches and retries, replication."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import exists
from .tail import deliver

#: Backoff doubles up to so many times the first wait, and to so many seconds.
BACKOFF_TIMES, BACKOFF_SECONDS = 64, 60.0
#: Batches of a sink that one task pushes of one stream.
STRETCH = 64


def json_lines(records: DataFrame) -> DataFrame:
    """(line): a record as JSON, its content in base64, without metadata."""
    return records.select(json_line().alias("line"))


def json_line() -> Column:
    return F.to_json(F.struct("namespace", "stream", "seq", "event_type", "content_type", "timestamp_ns", F.base64("content").alias("content")))


class Sink(Protocol):
    """Takes JSON lines; ``token`` names a batch, and the same token again must change nothing."""

    def push(self, lines: list[str], token: str) -> None: ...


class Retriable(Exception):
    """A failure that may pass."""


def push_with_retry(push: Callable[[], None], first_wait: float, tries: int, sleep: Callable[[float], None] = time.sleep) -> int:
    """Call ``push`` until it succeeds, waiting longer each time; the tries it took.  Only Retriable failures are tried again."""
    wait = first_wait
    for n in range(1, tries + 1):
        try:
            push()
            return n
        except Retriable:
            if n == tries:
                raise
            sleep(min(wait, BACKOFF_SECONDS))
            wait = min(wait * 2, first_wait * BACKOFF_TIMES)
    return tries


def _pushed(rows: Iterable, sink: Sink, size: int, label: str, first_wait: float, tries: int) -> None:
    held: list = []

    def flush() -> None:
        if held:
            token = f"{label}:{held[0].seq}-{held[-1].seq}"
            push_with_retry(lambda: sink.push([r.line for r in held], token), first_wait, tries)
            held.clear()

    for r in rows:
        held.append(r)
        if len(held) >= size:
            flush()
    flush()


def to_sink(sink: Sink, size: int = 1000, first_wait: float = 0.1, tries: int = 10) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: executors push their partitions, in batches of ``size`` by stream and seq, each with its token.

    Rows are deduplicated by stream and seq first, for a source may deliver twice.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(["namespace", "stream", "seq"]).withColumn("line", json_line())
        # A long stream is several stretches of its numbers, the same ones however often the batch comes: so are the tokens.
        rows = rows.select("namespace", "stream", F.floor(F.col("seq") / (size * STRETCH)).alias("stretch"), "seq", "line")
        rows = rows.repartition("namespace", "stream", "stretch").sortWithinPartitions("namespace", "stream", "stretch", "seq")

        def partition(part: Iterable) -> None:
            from itertools import groupby

            for key, group in groupby(part, key=lambda r: (r.namespace, r.stream, r.stretch)):
                _pushed(group, sink, size, "/".join(key[:2]), first_wait, tries)

        rows.foreachPartition(partition)

    return each


def export(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """First all there is, then what comes: one query whose checkpoint is the export's progress.

    With ``once=False`` rows wait ``seconds`` at most before a batch, however small, is flushed to the sink.
    """
    return deliver(stream, each, checkpoint, **options)


def replicate(path: str, epoch: int, known_epoch: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that copies records to a standby's table at ``path``.

    Records that the standby has (by gid) are passed over, so a batch may come
    twice; a primary of an older epoch than the standby knows is refused.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if epoch < known_epoch():
            raise PermissionError("the primary's epoch is over")
        spark = batch.sparkSession
        ends = batch.agg(F.min("gid"), F.max("gid")).first()
        if ends[0] is None:
            return
        there = exists(spark, path)
        have = spark.read.parquet(path).select("gid").where(F.col("gid").between(*ends)) if there else batch.select("gid").limit(0)
        batch.dropDuplicates(["gid"]).join(have, "gid", "left_anti").write.mode("append").parquet(path)

    return each


def acknowledged(acks: int, standbys: int, policy: str | int) -> bool:
    """Whether an append is replicated: by 'all', a 'quorum' of primary and standbys, or a number of standbys."""
    need = standbys if policy == "all" else (standbys + 1) // 2 if policy == "quorum" else int(policy)
    return acks >= need

"""Streams of a record table's folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..schema import RECORD_SCHEMA


def open_stream(spark: SparkSession, path: str, files_per_batch: int = 0, schema: StructType = RECORD_SCHEMA) -> DataFrame:
    """All records of the table at ``path`` and those to come; a batch takes ``files_per_batch`` files, 0 for all there are."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def resume_point(from_seq: int, committed: int | None) -> int:
    """Where a tail begins: at ``from_seq``, which belongs to it; at 0 a consumer goes on after what it committed."""
    return committed + 1 if from_seq == 0 and committed is not None else from_seq


def tail(records: DataFrame, namespace: str, stream: str, from_seq: int = 0, committed: int | None = None, shards: list[int] | None = None) -> DataFrame:
    """A stream's records from the resume point on; works on a batch as on a stream."""
    out = records.where((F.col("namespace") == namespace) & (F.col("stream") == stream) & (F.col("seq") >= resume_point(from_seq, committed)))
    return out.where(F.col("shard_id").isin(*shards)) if shards else out


def subscribe(records: DataFrame, event_types: list[str], committed: int = 0) -> DataFrame:
    """Records of the event types (one at least) after ``committed``: replay and what comes, without a seam."""
    if not event_types:
        raise ValueError("a subscription names an event type")
    return records.where(F.col("event_type").isin(*event_types) & (F.col("seq") > committed))


def consume(records: DataFrame, assignment: DataFrame, offsets: DataFrame) -> DataFrame:
    """Each member's records: a stream joined with the static assignment (group, shard, member) and offsets (group, shard, seq)."""
    from ..operators.consumers import consume as batch

    return batch(records, assignment, offsets)


def live_at(records: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Records after the cutoffs that are known when they are delivered; what was delivered is not taken back by a later marker."""
    from ..operators.live import live

    return live(records, cutoffs)


def deliver(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = True,
    seconds: float = 1.0,
    name: str | None = None,
) -> StreamingQuery:
    """Run a stream into ``each(batch, batch_id)``; the checkpoint remembers what was delivered.

    ``once`` takes all there is, in batches, and ends; else new files are taken every ``seconds``.
    """
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def drain(stream: DataFrame, to: str, checkpoint: str) -> None:
    """Write all there is to Parquet files at ``to`` and return."""
    stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress(query: StreamingQuery) -> dict:
    """Rows of the last batch and whether more wait: a heartbeat."""
    last = query.lastProgress
    return {"rows": int(last["numInputRows"]) if last else 0, "active": query.isActive, "waiting": bool(query.status["isDataAvailable"])}

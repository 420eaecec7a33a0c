"""Plain tables as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import encode_gid
from ..operators.ranges import number_rows
from ..schema import DEFAULT_CONTENT_TYPE

#: Shards that fixture logs are dealt to.
SHARDS = 4


def _ns(ts: Column) -> Column:
    """Nanoseconds of a timestamp with or without zone; the session's zone is UTC."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def _record(df: DataFrame, **columns: Column) -> DataFrame:
    fixed = {
        "namespace": F.lit("fixture"),
        "namespace_id": F.lit(1).cast("long"),
        "stream_id": F.lit(1).cast("long"),
        "content_type": F.lit(DEFAULT_CONTENT_TYPE),
        "hash_n": F.lit(None).cast("binary"),
        "timestamp_ns": F.lit(0).cast("long"),
    }
    made = fixed | columns
    order = ["namespace", "stream", "namespace_id", "stream_id", "seq", "gid", "shard_id", "event_type", "content_type", "timestamp_ns", "metadata", "content", "hash_n"]
    return df.select(*[made[c].alias(c) for c in order])


def _events_metadata() -> Column:
    own = F.create_map(
        F.lit("user_id"),
        F.col("user_id").cast("string"),
        F.lit("user_day"),
        F.concat_ws("|", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")),
        F.lit("value"),
        F.col("value").cast("string"),
    )
    return F.map_concat(F.from_json("props", "map<string,string>"), own)


def events_log(events: DataFrame) -> DataFrame:
    """One stream, ``events``: seq is event_id + 1."""
    seq = (F.col("event_id") + 1).cast("long")
    return _record(
        events,
        stream=F.lit("events"),
        seq=seq,
        gid=(seq - 1),
        shard_id=F.lit(0),
        event_type=F.col("event_type"),
        timestamp_ns=_ns(F.col("ts")),
        metadata=_events_metadata(),
        content=F.col("props").cast("binary"),
    )


def events_by_user(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A stream for each user, dealt to shards by user; records also have local_seq."""
    shard = F.pmod(F.col("user_id"), F.lit(shards)).cast("int")
    numbered = number_rows(events.withColumn("shard", shard), "event_id", ["shard"], column="local")
    numbered = number_rows(numbered, "event_id", ["user_id"], column="n").withColumn("local", F.col("local") - 1)
    return _record(
        numbered,
        stream=F.concat(F.lit("user-"), F.col("user_id").cast("string")),
        stream_id=F.col("user_id") + 1,
        seq=F.col("n"),
        gid=encode_gid(F.col("local"), F.col("shard"), shards),
        shard_id=F.col("shard"),
        event_type=F.col("event_type"),
        timestamp_ns=_ns(F.col("ts")),
        metadata=_events_metadata(),
        content=F.col("props").cast("binary"),
    )


def conversations_log(conversations: DataFrame) -> DataFrame:
    """A stream for each conversation: seq is turn + 1, the event type is the role."""
    seq = (F.col("turn") + 1).cast("long")
    return _record(
        conversations,
        stream=F.concat(F.lit("conv-"), F.col("conv_id").cast("string")),
        stream_id=F.col("conv_id") + 1,
        seq=seq,
        gid=seq - 1,
        shard_id=F.lit(0),
        event_type=F.col("role"),
        metadata=F.create_map(
            F.lit("conv_id"), F.col("conv_id").cast("string"), F.lit("n_chars"), F.char_length("text").cast("string")
        ),
        content=F.col("text").cast("binary"),
    )


def lineitem_log(lineitem: DataFrame) -> DataFrame:
    """A stream for each order: seq is the line number, with the gaps and repeats that the table has."""
    seq = F.col("l_linenumber").cast("long")
    return _record(
        lineitem,
        stream=F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")),
        stream_id=F.col("l_orderkey") + 1,
        seq=seq,
        gid=seq - 1,
        shard_id=F.lit(0),
        event_type=F.col("l_returnflag"),
        metadata=F.create_map(
            F.lit("part"), F.col("l_partkey").cast("string"), F.lit("supp"), F.col("l_suppkey").cast("string"), F.lit("status"), F.col("l_linestatus")
        ),
        content=F.lit(None).cast("binary"),
    )


def orders_log(orders: DataFrame) -> DataFrame:
    """One stream, ``orders``: seq is o_orderkey + 1."""
    seq = (F.col("o_orderkey") + 1).cast("long")
    return _record(
        orders,
        stream=F.lit("orders"),
        seq=seq,
        gid=seq - 1,
        shard_id=F.lit(0),
        event_type=F.col("o_orderstatus"),
        timestamp_ns=_ns(F.col("o_orderdate")),
        metadata=F.create_map(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("priority"), F.col("o_orderpriority")),
        content=F.lit(None).cast("binary"),
    )

"""The record table: a fixed envelope around opaque content."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("namespace_id", T.LongType()),
        T.StructField("stream_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("gid", T.LongType()),
        T.StructField("shard_id", T.IntegerType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content", T.BinaryType()),
        T.StructField("hash_n", T.BinaryType()),
    ]
)
COLUMNS = [f.name for f in RECORD_SCHEMA.fields]
#: What names a stream.
STREAM = ["namespace", "stream"]

#: Event type of the marker that deletes all of a stream up to itself.
MARKER = "system.stream_deleted"
#: Content type of a record that names none.
DEFAULT_CONTENT_TYPE = "application/json"

# Limits of names, metadata and content.
NAMESPACE_CHARS, STREAM_CHARS, EVENT_TYPE_CHARS, METADATA_KEY_CHARS = 64, 128, 128, 64
METADATA_ENTRIES, METADATA_BYTES = 16, 4096
CONTENT_BYTES, CONTENT_BYTES_CAP = 1 << 20, 64 << 20
#: Rows of a page when a scan names no size.
PAGE_ROWS = 10_000

#: Prefix of a column that holds one metadata key's values, so that predicates on it reach the Parquet scan.
PROMOTED = "md_"

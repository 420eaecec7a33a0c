"""Validity of names, metadata and content, as predicate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (
    CONTENT_BYTES,
    EVENT_TYPE_CHARS,
    METADATA_BYTES,
    METADATA_ENTRIES,
    METADATA_KEY_CHARS,
    NAMESPACE_CHARS,
    STREAM_CHARS,
)


def _ok(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def namespace_ok(c: Column) -> Column:
    """1 to 64 of a-z, 0-9, _ and -, no leading _."""
    return _ok(c, rf"\A[a-z0-9-][a-z0-9_-]{{0,{NAMESPACE_CHARS - 1}}}\z")


def stream_ok(c: Column) -> Column:
    """1 to 128 of a-z, 0-9, _, - and /; no leading _ or /, no // and no / at the end."""
    return _ok(c, rf"\A(?!.*//)[a-z0-9-][a-z0-9_/-]{{0,{STREAM_CHARS - 1}}}\z") & ~F.coalesce(c.endswith("/"), F.lit(False))


def event_type_ok(c: Column) -> Column:
    """1 to 128 of a-z, 0-9, _, . and -."""
    return _ok(c, rf"\A[a-z0-9_.-]{{1,{EVENT_TYPE_CHARS}}}\z")


def metadata_keys_ok(metadata: Column) -> Column:
    """Every key 1 to 64 of a-z, 0-9, _, . and -; no metadata is fine."""
    pattern = rf"\A[a-z0-9_.-]{{1,{METADATA_KEY_CHARS}}}\z"
    return F.coalesce(F.forall(F.map_keys(metadata), lambda k: k.rlike(pattern)), F.lit(True))


def metadata_size_ok(metadata: Column) -> Column:
    """16 entries and 4096 bytes of keys and values at most."""
    total = F.aggregate(
        F.map_entries(metadata), F.lit(0), lambda a, e: a + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0))
    )
    return F.coalesce((F.size(metadata) <= METADATA_ENTRIES) & (total <= METADATA_BYTES), F.lit(True))


def rejection(content_bytes: int = CONTENT_BYTES, names: bool = True) -> Column:
    """Why a row of the record schema can't be appended; null where it can.  ``names=False`` leaves event types and metadata keys alone."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    why = (
        F.when(~namespace_ok(F.col("namespace")), "namespace")
        .when(~stream_ok(F.col("stream")), "stream")
        .when(~metadata_size_ok(F.col("metadata")), "metadata")
        .when(size > content_bytes, "content")
    )
    if names:
        why = why.when(~event_type_ok(F.col("event_type")), "event_type").when(~metadata_keys_ok(F.col("metadata")), "metadata_key")
    return why

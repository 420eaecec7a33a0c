"""The envelope that native segment files keep around a record's content.

Little-endian: magic u16, version u8, flags u8, namespace_id u32, stream_id u64,
seq u64, event type and content type (length u16, UTF-8 each), number of metadata
entries u8, entries (key length u8, key, value length u16, value) by key,
timestamp_ns u64, content (length u32, bytes).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..schema import METADATA_BYTES, METADATA_ENTRIES

# The envelope's numbers.
MAGIC, VERSION = 0x4C52, 1
_HEAD = struct.Struct("<HBBIQQ")

FIELDS = "namespace_id long, stream_id long, seq long, event_type string, content_type string, metadata map<string,string>, record_ns long, user_content binary"


class Malformed(ValueError):
    """Bytes that are no envelope."""


def pack(
    namespace_id: int, stream_id: int, seq: int, event_type: str, content_type: str, metadata: dict[str, str], timestamp_ns: int, content: bytes
) -> bytes:
    entries = [(k.encode(), v.encode()) for k, v in sorted(metadata.items())]
    if len(entries) > METADATA_ENTRIES or sum(len(k) + len(v) for k, v in entries) > METADATA_BYTES:
        raise ValueError("too much metadata")
    out = [_HEAD.pack(MAGIC, VERSION, 0, namespace_id, stream_id, seq)]
    for s in (event_type.encode(), content_type.encode()):
        out += [struct.pack("<H", len(s)), s]
    out.append(bytes([len(entries)]))
    for k, v in entries:
        out += [bytes([len(k)]), k, struct.pack("<H", len(v)), v]
    return b"".join([*out, struct.pack("<QI", timestamp_ns, len(content)), content])


def unpack(data: bytes) -> tuple:
    """The values of FIELDS; raises Malformed."""
    at = _HEAD.size

    def part(width: str) -> bytes:
        nonlocal at
        (n,) = struct.unpack_from(width, data, at)
        at += struct.calcsize(width)
        if at + n > len(data):
            raise Malformed("envelope is cut off")
        at += n
        return data[at - n : at]

    try:
        magic, version, _, namespace_id, stream_id, seq = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise Malformed("envelope magic" if magic != MAGIC else "envelope version")
        event_type, content_type = part("<H").decode(), part("<H").decode()
        (entries,) = struct.unpack_from("<B", data, at)
        at += 1
        metadata = {}
        for _ in range(entries):
            k = part("<B").decode()
            metadata[k] = part("<H").decode()
        (stamp,) = struct.unpack_from("<Q", data, at)
        at += 8
        return namespace_id, stream_id, seq, event_type, content_type, metadata, stamp, part("<I")
    except struct.error:
        raise Malformed("envelope is cut off") from None
    except UnicodeDecodeError:
        raise Malformed("envelope is not UTF-8") from None


def decode(rows: DataFrame) -> DataFrame:
    """Rows of a segment file (``content``, ``corrupt``) with FIELDS; what is no envelope has nulls and says so in ``corrupt``."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    plain = rows.drop(*names)
    schema = plain.limit(0).selectExpr("*", *(f"cast(null as {f.split(' ', 1)[1]}) as {f.split()[0]}" for f in FIELDS.split(", "))).schema

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, why = [], list(pdf["corrupt"])
            for i, c in enumerate(pdf["content"]):
                row: tuple = (None,) * len(names)
                if c is not None and not isinstance(why[i], str):
                    try:
                        row = unpack(bytes(c))
                    except Malformed as e:
                        why[i] = str(e)
                out.append(row)
            columns = dict(zip(names, zip(*out) if out else [()] * len(names)))
            whole = {n: pd.Series(v, dtype="Int64" if n in ("namespace_id", "stream_id", "seq", "record_ns") else object, index=pdf.index) for n, v in columns.items()}
            yield pdf.assign(corrupt=why, **whole)

    return plain.mapInPandas(decoded, schema)

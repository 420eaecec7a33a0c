"""Native segment files, read in parallel: one task for each file, then one for each frame.

A file is a header of 128 bytes and records, each (little-endian)

    length u32 | sequence u64 | timestamp_ns u64 | content length u32 | content | hash 32 bytes | CRC-32C u32

where length counts all of it and the checksum covers all before itself.  In
compressed or encrypted files, records are in frames (stored length u32, raw
length u32, payload): zstd, then AES-GCM with the nonce of 12 bytes in front.
What is cut off, fails its checksum or opens with no key ends up in ``corrupt``
with what could be read.  After a damaged length the records go on where the
next one is whole and has a right checksum; the stretch between is one row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksum import crc32c_of
from ..functions.crypto import decrypt_with_ring

# The file format's numbers.
MAGIC, VERSION, HEADER_BYTES, HASH_BYTES = 0x4C474442, 1, 128, 32
_HEADER = struct.Struct("<IHBB32sQIIQQI32sB16s3s")
_FIXED = struct.Struct("<IQQI")
_FRAME = struct.Struct("<II")
FLAG_COMPRESSED, FLAG_ENCRYPTED = 0x04, 0x08
_OVERHEAD = _FIXED.size + HASH_BYTES + 4
#: Bytes that a search for the next record looks at together.
_SEARCH = 1 << 20

SCHEMA = "path string, segment_id long, partition_id long, sequence long, timestamp_ns long, content binary, hash_n binary, corrupt string"
_FRAMES = "path string, segment_id long, partition_id long, flags long, frame long, payload binary, raw_size long, corrupt string"


def pack_header(base_sequence: int, segment_id: int, partition_id: int = 0, flags: int = 0) -> bytes:
    head = _HEADER.pack(MAGIC, VERSION, flags, 0, bytes(32), base_sequence, partition_id, segment_id, 0, 0, 0, bytes(32), 1, bytes(16), bytes(3))
    return head[:72] + struct.pack("<I", int(crc32c_of([head[:72]])[0])) + head[76:]


def pack_record(sequence: int, timestamp_ns: int, content: bytes, link: bytes = bytes(HASH_BYTES)) -> bytes:
    body = _FIXED.pack(_OVERHEAD + len(content), sequence, timestamp_ns, len(content)) + content + link
    return body + struct.pack("<I", int(crc32c_of([body])[0]))


def pack_frame(raw: bytes, compressed: bool = True) -> bytes:
    """A frame that is not encrypted."""
    import zstandard

    payload = zstandard.compress(raw) if compressed else raw
    return struct.pack("<II", len(payload), len(raw)) + payload


def frames(path: str, data: bytes) -> Iterator[tuple]:
    """(path, segment_id, partition_id, flags, frame, payload, raw_size, corrupt): a file without frames is one payload."""
    if len(data) < HEADER_BYTES:
        yield path, None, None, 0, 0, None, None, "header is cut off"
        return
    magic, version, flags, _, _, _, partition, segment, _, _, crc, *_ = _HEADER.unpack_from(data)
    why = "magic" if magic != MAGIC else "version" if version != VERSION else "header checksum" if crc != int(crc32c_of([data[:72]])[0]) else None
    if why:
        yield path, None, None, 0, 0, None, None, why
    elif not flags & (FLAG_COMPRESSED | FLAG_ENCRYPTED):
        yield path, segment, partition, flags, 0, data[HEADER_BYTES:], None, None
    else:
        at, k = HEADER_BYTES, 0
        while at + _FRAME.size <= len(data):
            stored, raw = _FRAME.unpack_from(data, at)
            if stored == 0:  # preallocated space
                return
            at += _FRAME.size
            if at + stored > len(data):
                yield path, segment, partition, flags, k, None, raw, "frame is cut off"
                return
            yield path, segment, partition, flags, k, data[at : at + stored], raw, None
            at, k = at + stored, k + 1


def next_record(data: bytes, at: int) -> int | None:
    """Where the first whole record at ``at`` or later begins: both its lengths agree and its checksum is right.

    A record that lies inside another's content counts too, where the outer one is damaged.
    """
    size_at, end = _FIXED.size - 4, len(data) - _OVERHEAD + 1
    for low in range(at, end, _SEARCH):
        high = min(low + _SEARCH, end)
        block = np.frombuffer(data, np.uint8, high - low + size_at + 3, low).astype(np.int64)
        number = block[:-3] | block[1:-2] << 8 | block[2:-1] << 16 | block[3:] << 24
        length, size = number[: high - low], number[size_at:]
        whole = (length == size + _OVERHEAD) & (length <= len(data) - np.arange(low, high))
        for k in np.flatnonzero(whole).tolist():
            last = low + k + int(length[k]) - 4
            if int(crc32c_of([data[low + k : last]])[0]) == struct.unpack_from("<I", data, last)[0]:
                return low + k
    return None


def records_of(path: str, segment: int, partition: int, flags: int, payload: bytes | None, raw_size: int | None) -> list[tuple]:
    """The rows of one payload, which is no longer encrypted."""
    if payload is None:
        return [(path, segment, partition, None, None, None, None, "no key opens the frame")]
    data = payload
    if flags & FLAG_COMPRESSED:
        import zstandard

        try:
            # An object of its own for each frame: a frame's raw size bounds what it may become.
            data = zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, raw_size))
        except zstandard.ZstdError:
            return [(path, segment, partition, None, None, None, None, "frame does not decompress")]
    if raw_size is not None and len(data) != raw_size:
        return [(path, segment, partition, None, None, None, None, "frame length")]
    rows, bodies, at = [], [], 0
    while at + 4 <= len(data):
        (length,) = struct.unpack_from("<I", data, at)
        if length == 0:  # preallocated space
            break
        if length < _OVERHEAD or at + length > len(data):
            after = next_record(data, at + 1)
            rows.append([path, segment, partition, None, None, None, None, "record is cut off" if after is None else "record length"])
            if after is None:
                break
            at = after
            continue
        _, sequence, stamp, size = _FIXED.unpack_from(data, at)
        start = at + _FIXED.size
        whole = size + _OVERHEAD == length
        if not whole:  # one of the two lengths is damaged, and which one is not known
            rows.append([path, segment, partition, sequence, stamp, None, None, "content length"])
            after = next_record(data, at + 1)
            if after is None:
                break
            at = after
            continue
        content = data[start : start + size]
        link = data[at + length - 4 - HASH_BYTES : at + length - 4]
        (stored,) = struct.unpack_from("<I", data, at + length - 4)
        bodies.append((len(rows), data[at : at + length - 4], stored))
        rows.append([path, segment, partition, sequence, stamp, content, link, None])
        at += length
    for (k, _, stored), found in zip(bodies, crc32c_of([b for _, b, _ in bodies])):
        if stored != found and rows[k][-1] is None:
            rows[k][-1] = "record checksum"
    return [tuple(r) for r in rows]


def parse(path: str, data: bytes) -> list[tuple]:
    """The rows of one file that is not encrypted."""
    rows = []
    for _, segment, partition, flags, _, payload, raw, why in frames(path, data):
        if why:
            rows.append((path, segment, partition, None, None, None, None, why))
        else:
            rows += records_of(path, segment, partition, flags, None if flags & FLAG_ENCRYPTED else payload, raw)
    return rows


def read_segments(spark: SparkSession, path: str, keys: list[bytes] | None = None) -> DataFrame:
    """Rows of SCHEMA of all segment files that ``path`` (a folder or pattern of any store that Spark reads) holds.

    ``keys``: the ring of keys of 32 bytes that encrypted frames are tried with, in the JVM.
    """
    integers = ("segment_id", "partition_id", "sequence", "timestamp_ns", "flags", "frame", "raw_size")

    def table(found: list[tuple], schema: str) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame(found, columns=names).astype({c: "Int64" for c in names if c in integers})

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                for frame in frames(name, bytes(data)):
                    yield table([frame], _FRAMES)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                if r.corrupt is not None:
                    found = [(r.path, r.segment_id, r.partition_id, None, None, None, None, r.corrupt)]
                else:
                    found = records_of(r.path, r.segment_id, r.partition_id, r.flags, None if r.payload is None else bytes(r.payload), r.raw_size)
                if found:
                    yield table(found, SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).select("path", "content")
    sealed = F.col("flags").bitwiseAND(F.lit(FLAG_ENCRYPTED)) != 0
    opened = F.when(sealed, decrypt_with_ring(F.col("payload"), keys) if keys else F.lit(None).cast("binary")).otherwise(F.col("payload"))
    return files.mapInPandas(framed, _FRAMES).withColumn("payload", opened).mapInPandas(rows, SCHEMA)

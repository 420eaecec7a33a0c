"""CRC-32C (Castagnoli) and hash links.  Spark's crc32() is another polynomial."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The polynomial, reflected.
_CASTAGNOLI = 0x82F63B78


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_CASTAGNOLI), t >> 1).astype(np.uint32)
    return t


_TABLE = _table()


def crc32c_of(values: list[bytes | None]) -> np.ndarray:
    """Checksums of many byte strings at once, a byte position at a time over those that are long enough; null as empty."""
    rows = [v or b"" for v in values]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(rows), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = sizes[order]
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for i in range(int(longest[0]) if len(rows) else 0):
        n = int(np.searchsorted(-longest, -i, "left"))  # those longer than i
        c = crc[:n]
        crc[:n] = _TABLE[(c ^ flat[starts[:n] + i]) & 0xFF] ^ (c >> 8)
    out = np.empty(len(rows), np.int64)
    out[order] = (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    return out


@F.pandas_udf(LongType())
def _crc32c(values: pd.Series) -> pd.Series:
    return pd.Series(crc32c_of([None if v is None else bytes(v) for v in values]))


def crc32c(value: Column) -> Column:
    """CRC-32C of bytes, or of a string's UTF-8, as a long; null as empty."""
    return _crc32c(value.cast("binary"))


def sha256_chain(previous: Column, content: Column) -> Column:
    """The next link of a hash chain: SHA-256 of the link before and the content."""
    return F.unhex(F.sha2(F.concat(previous, F.coalesce(content, F.lit(b""))), 256))

"""BLAKE3 after the published paper, over many inputs at once.

Chunks of 1,024 bytes of all inputs are lanes of one array; each step
compresses one block of every lane that still has one.  Then neighbouring
nodes are joined level by level, an odd last one moving up as it is.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# The paper's initial words, order of message words, and flags.
_IV = [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19]
_PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT, _KEYED = 1, 2, 4, 8, 16
_BLOCK, _CHUNK = 64, 1024
#: Columns, then diagonals, of the state.
_MIXES = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
#: Bytes of input whose chunks are worked on at once; a longer input is by itself.
GROUP_BYTES = 8 << 20


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values (8, lanes) of ``cv`` (8, lanes) and blocks ``words`` (16, lanes)."""
    lanes = cv.shape[1]
    v = [*cv, *(np.full(lanes, w, np.uint32) for w in _IV[:4])]
    v += [(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_MIXES):
            for word, right, left in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = _turn(v[d] ^ v[a], right)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], left)
        m = [m[i] for i in _PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def _group(rows: list[bytes], key: np.ndarray, mode: int) -> list[bytes]:
    chunks = np.array([max(1, -(-len(r) // _CHUNK)) for r in rows], np.int64)
    first = np.cumsum(chunks) - chunks
    lanes = int(chunks.sum())
    data = np.zeros((lanes, _CHUNK), np.uint8)
    size = np.full(lanes, _CHUNK, np.int64)
    for r, at, n in zip(rows, first, chunks):
        data[at : at + n].reshape(-1)[: len(r)] = np.frombuffer(r, np.uint8)
        size[at + n - 1] = len(r) - (n - 1) * _CHUNK
    words = data.view("<u4").reshape(lanes, _CHUNK // _BLOCK, 16)
    counter = np.arange(lanes) - np.repeat(first, chunks)
    alone = np.repeat(chunks == 1, chunks)
    blocks = np.maximum(1, -(-size // _BLOCK))
    cv = np.repeat(key[:, None], lanes, axis=1)
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        last = blocks[on] == b + 1
        flags = mode + _CHUNK_START * (b == 0) + _CHUNK_END * last + _ROOT * (last & alone[on])
        cv[:, on] = _compress(cv[:, on], words[on, b].T, counter[on], np.minimum(_BLOCK, size[on] - b * _BLOCK), flags)
    while int(chunks.max()) > 1:
        pairs = chunks // 2
        left = np.repeat(first, pairs) + 2 * (np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs))
        root = np.repeat(chunks == 2, pairs)
        n = len(left)
        joined = _compress(
            np.repeat(key[:, None], n, axis=1), np.concatenate([cv[:, left], cv[:, left + 1]]), np.zeros(n, np.int64), np.full(n, _BLOCK), mode + _PARENT + _ROOT * root
        )
        after = (chunks + 1) // 2
        begin = np.cumsum(after) - after
        up = np.empty((8, int(after.sum())), np.uint32)
        up[:, np.repeat(begin, pairs) + (left - np.repeat(first, pairs)) // 2] = joined
        odd = chunks % 2 == 1
        up[:, (begin + after - 1)[odd]] = cv[:, (first + chunks - 1)[odd]]
        cv, first, chunks = up, begin, after
    return [x.astype("<u4").tobytes() for x in cv.T]


def blake3_of(values: list[bytes | None], key: bytes | None = None) -> list[bytes]:
    """32-byte hashes, keyed with a ``key`` of 32 bytes if there is one; null as empty."""
    words = np.array(struct.unpack("<8I", key) if key else _IV, np.uint32)
    out: list[bytes] = []
    group: list[bytes] = []
    held = 0
    for v in values:
        v = v or b""
        if group and held + max(len(v), _CHUNK) > GROUP_BYTES:
            out += _group(group, words, _KEYED if key else 0)
            group, held = [], 0
        group.append(v)
        held += max(len(v), _CHUNK)
    return out + (_group(group, words, _KEYED if key else 0) if group else [])


def blake3(value: Column, key: bytes | None = None) -> Column:
    """BLAKE3 of bytes, or of a string's UTF-8, as binary; null as empty.  ``key``: 32 bytes for the keyed hash."""
    if key is not None and len(key) != 32:
        raise ValueError("a key has 32 bytes")

    @F.pandas_udf(BinaryType())
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series(blake3_of([None if v is None else bytes(v) for v in values], key))

    return hashed(value.cast("binary"))


def blake3_chain(previous: Column, content: Column, key: bytes) -> Column:
    """The next link of a keyed hash chain: keyed BLAKE3 of the link before and the content."""
    return blake3(F.concat(previous, F.coalesce(content, F.lit(b""))), key)

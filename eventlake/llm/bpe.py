"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The merge procedure of byte-level BPE is reproduced without running merges: a
sequence of vocabulary tokens is what BPE yields exactly if every adjacent pair
of it is what BPE yields for the pair's own bytes ("compatible").  So encoding
walks left to right, takes the longest match at the position, falls back to
the next shorter token that is a prefix of it while the pair with the token
before is incompatible, and steps back where none is left.  A position from
which all choices failed is never entered again, which bounds the work by the
number of positions times the longest token: linear time, where repeated merging
is quadratic on long runs without a word break.

Matches come from a pyahocorasick automaton over the tokens' bytes, mapped to
Latin-1 so that one character is one byte.  Pair compatibility is memoised.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_apply, ref, struct_array

#: Entries of each worker's piece and pair caches; a full cache starts afresh.  Longer pieces than PIECE_CHARS are not kept.
PIECE_CACHE, PAIR_CACHE, PIECE_CHARS = 300_000, 400_000, 64
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """A tokenizer file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Memo(dict):
    """A bounded dict that computes missing values."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class BytePairCodec:
    """Encodes single pieces by backtracking; ``ranks`` maps a token's bytes to its id, which is its merge rank."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ids = {token.decode("latin-1"): i for token, i in ranks.items()}
        self.tokens = {i: token for token, i in ranks.items()}
        text = {i: token for token, i in self.ids.items()}
        self.text = text
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in self.ids.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.length = {i: len(t) for i, t in text.items()}
        # The next shorter token that is a prefix of each token.
        self.shorter: dict[int, int | None] = {}
        for token, i in self.ids.items():
            n = len(token) - 1
            while n and token[:n] not in self.ids:
                n -= 1
            self.shorter[i] = self.ids[token[:n]] if n else None
        # The two tokens whose merge made each token; a token that no merge makes stands for itself.
        self.halves: dict[int, tuple[int, int]] = {}
        # Pairs are kept as one number: left << 32 | right.
        self.compatible = _Memo(lambda pair: self._compatible((pair >> 32, pair & 0xFFFFFFFF)), PAIR_CACHE)
        self.whole_only: set[int] = set()
        for i in sorted(text):
            self.halves[i] = self._split(i)

    def _split(self, i: int) -> tuple[int, int]:
        token = self.text[i]
        if len(token) == 1:
            return i, i
        left = self.shorter[i]
        while left is not None:
            right = self.ids.get(token[self.length[left] :])
            if left < i and right is not None and right < i and self._compatible((left, right), i):
                return left, right
            left = self.shorter[left]
        self.whole_only.add(i)
        return i, i

    def _compatible(self, pair: tuple[int, int], below: int = _NONE) -> bool:
        """Whether BPE, given both tokens' bytes in one piece, keeps the border between them.

        Undoes the later of the two sides' last merges step by step; the border
        falls if the tokens that touch it at some time merge earlier than the
        merge that was undone.  ``below``: merges of this rank and later don't count.
        """
        left, right = pair
        limit, text, halves, ids = below, self.text, self.halves, self.ids
        while True:
            joined = ids.get(text[left] + text[right])
            if joined is not None and joined < limit:
                return False
            a, b = halves[left], halves[right]
            can_left, can_right = a[0] != left, b[0] != right
            if can_left and (left > right or not can_right):
                limit, left = left, a[1]
            elif can_right:
                limit, right = right + 1, b[0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        s = piece.decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        length, shorter, compatible = self.length, self.shorter, self.compatible
        n = len(s)
        longest = [None] * n
        for end, token in self.automaton.iter(s):
            longest[end - length[token] + 1] = token
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + length[token]
                if open_at[end] and token not in self.whole_only and (last is None or compatible[last << 32 | token]):
                    break
                token = shorter[token]
            if token is None:
                if last is None:
                    raise ValueError("the vocabulary lacks a single byte")
                open_at[at] = 0
                out.pop()
                at -= length[last]
                token = last
            else:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
        return out


class TextCodec:
    """Whole texts: each match of ``pattern`` is a piece of its own, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.codec = BytePairCodec(ranks)
        self.pieces = regex.compile(pattern).findall
        pack = self._pack = lambda ids: b"".join([i.to_bytes(4, "little") for i in ids])
        encode = self.codec.encode_piece
        self.packed = _Memo(lambda piece: pack(encode(piece.encode())), PIECE_CACHE)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        packed, make = self.packed, self.packed.make
        pieces = self.pieces(text)
        if len(max(pieces, key=len, default="")) <= PIECE_CHARS:
            return b"".join(map(packed.__getitem__, pieces))
        return b"".join([packed[p] if len(p) <= PIECE_CHARS else make(p) for p in pieces])


class Decoder:
    """The tokens' bytes alone: decoding needs no automaton."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: token for token, i in ranks.items()}

    def decode(self, packed: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def text_codec(path: str, pattern: str) -> TextCodec:
    """One codec per worker process and vocabulary file."""
    return TextCodec(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Append ``ids`` (binary: little-endian unsigned 32-bit token ids, the usual layout of token shards) and ``n_tokens``.

    ``decoded`` names a further column for the bytes that the ids decode to: a
    round trip in the same process, which :func:`decode` after this would double.
    ``path`` is the vocabulary file on every machine, as installed; it has all 256
    single bytes, as byte-level vocabularies do, else what lacks one is an error.  Null and
    empty texts give no tokens.  Row-local: no shuffle, repeated rows each give
    their result; memory is bounded by a batch and the caches.
    """
    fields = [(ids, pa.binary()), ("n_tokens", pa.int64())] + ([(decoded, pa.binary())] if decoded else [])
    kinds = [T.BinaryType(), T.LongType(), T.BinaryType()]

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        codec, back = text_codec(path, pattern), decoder(path).decode if decoded else None
        for (texts,) in batches:
            packed = [codec.encode(t.as_py() or "") for t in texts]
            columns = [packed, [len(p) >> 2 for p in packed]] + ([[back(p) for p in packed]] if decoded else [])
            yield struct_array(columns, fields)

    return arrow_apply(df, [ref(text)], T.StructType([T.StructField(n, k) for (n, _), k in zip(fields, kinds)]), process)


def decode(df: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Append ``to`` (binary), the bytes of the ids that :func:`encode` packed; null ids give none.  Row-local."""
    out = T.StructType([T.StructField(to, T.BinaryType())])

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        tokens = decoder(path)
        for (packed,) in batches:
            yield struct_array([[tokens.decode(p.as_py() or b"") for p in packed]], [(to, pa.binary())])

    return arrow_apply(df, [ref(ids)], out, process)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded texts."""
    both = encode(df.select("doc_id", "text"), path, pattern, decoded="decoded")
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

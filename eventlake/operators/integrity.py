"""Sequence continuity and hash chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import blake3_chain, blake3_of
from ..functions.checksum import sha256_chain
from ..schema import STREAM
from .ranges import with_previous

#: The link before a chain's first record; the key itself in a keyed chain.
GENESIS = bytes(32)


def verify_chain(records: DataFrame, by: list[str] | None = None, from_seq: int | None = None, to_seq: int | None = None) -> DataFrame:
    """For each stream: ok, verified_from, verified_to, error_at_seq and n_records; tombstoned records count.

    The numbers must rise by one from the first; a gap or a repeat is reported
    at the number that was expected, 0 where all is well.  A stream of very many
    records is checked in ranges of its numbers.
    """
    by = by or STREAM
    rows = records.select(*by, "seq")
    if from_seq is not None:
        rows = rows.where(F.col("seq") >= from_seq)
    if to_seq is not None:
        rows = rows.where(F.col("seq") <= to_seq)
    # Until the first error each number is the one before and one more, so the least wrong expectation is the first.
    checked = with_previous(rows, "seq", "seq", by, "__before")
    wrong = F.when(F.col("seq") != F.col("__before") + 1, F.col("__before") + 1)
    return checked.groupBy(*by).agg(
        F.count(wrong).alias("n_wrong"),
        F.min("seq").alias("verified_from"),
        F.max("seq").alias("verified_to"),
        F.coalesce(F.min(wrong), F.lit(0)).alias("error_at_seq"),
        F.count(F.lit(1)).alias("n_records"),
    ).select(*by, (F.col("n_wrong") == 0).alias("ok"), "verified_from", "verified_to", "error_at_seq", "n_records")


def verify_hashes(records: DataFrame, by: list[str] | None = None, order: str = "gid", key: bytes | None = None) -> DataFrame:
    """Records with ``linked``: whether hash_n is the link of the hash before and the content.

    Links are SHA-256, with a ``key`` of 32 bytes keyed BLAKE3.  Each link needs
    only the stored one before it, so chains are checked in parallel, and a long
    one in ranges of ``order``.
    """
    by = by or ["shard_id"]
    before_each = with_previous(records, "hash_n", order, by, "__before").withColumn("__before", F.coalesce("__before", F.lit(key or GENESIS)))
    link = blake3_chain(F.col("__before"), F.col("content"), key) if key else sha256_chain(F.col("__before"), F.col("content"))
    return before_each.withColumn("linked", F.coalesce(F.col("hash_n") == link, F.lit(False))).drop("__before")


def broken_links(records: DataFrame, by: list[str] | None = None, order: str = "gid", key: bytes | None = None) -> DataFrame:
    """For each chain: ok, first_broken (null where all hold) and n_records."""
    by = by or ["shard_id"]
    checked = verify_hashes(records, by, order, key)
    bad = F.when(~F.col("linked"), F.col(order))
    return checked.groupBy(*by).agg((F.count(bad) == 0).alias("ok"), F.min(bad).alias("first_broken"), F.count(F.lit(1)).alias("n_records"))


def build_hashes(records: DataFrame, by: list[str] | None = None, order: str = "gid", key: bytes | None = None) -> DataFrame:
    """Records with hash_n, each chain's links one after the other: SHA-256, with a ``key`` of 32 bytes keyed BLAKE3.

    A link depends on the one before, so a chain is one sequential pass; it
    streams through in batches and holds one link, however long it is.  Chains
    that share a batch take their steps side by side.
    """
    import hashlib

    by = by or ["shard_id"]
    schema = records.drop("hash_n").withColumn("hash_n", F.lit(b"")).schema

    def hashes(inputs: list[bytes]) -> list[bytes]:
        return blake3_of(inputs, key) if key else [hashlib.sha256(x).digest() for x in inputs]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = None, b""
        for pdf in batches:
            if not len(pdf):
                continue
            names = list(zip(*(pdf[c] for c in by)))
            content = [bytes(c or b"") for c in pdf["content"]]
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            ends = [*starts[1:], len(names)]
            before = {a: key or GENESIS for a in starts}
            if names[0] == chain:
                before[0] = last
            out: list[bytes] = [b""] * len(names)
            on = list(zip(starts, ends))
            while on:
                for (i, _), h in zip(on, hashes([before[i] + content[i] for i, _ in on])):
                    out[i] = h
                on = [(i + 1, end) for i, end in on if i + 1 < end]
                before = {i: out[i - 1] for i, _ in on}
            chain, last = names[-1], out[-1]
            yield pdf.assign(hash_n=out)

    return records.drop("hash_n").repartition(*by).sortWithinPartitions(*by, order).mapInPandas(links, schema)

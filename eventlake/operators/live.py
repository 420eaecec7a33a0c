"""Tombstones: what of a stream is live, and how far a reader may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import gid_local
from ..schema import MARKER, STREAM


def tombstone_cutoffs(records: DataFrame, marker: str = MARKER) -> DataFrame:
    """(namespace, stream, cutoff): the last marker of each stream that has one."""
    return records.where(F.col("event_type") == marker).groupBy(*STREAM).agg(F.max("seq").alias("cutoff"))


def live(records: DataFrame, cutoffs: DataFrame | None = None, marker: str = MARKER) -> DataFrame:
    """Records after their stream's cutoff.  A marker is not live; what is appended after it is.

    Two columns of each tombstoned stream are joined; whether they are
    broadcast is left to their size at run time.
    """
    cutoffs = tombstone_cutoffs(records, marker) if cutoffs is None else cutoffs
    return records.join(cutoffs, STREAM, "left").where(F.col("seq") > F.coalesce("cutoff", F.lit(0))).drop("cutoff")


def within_boundary(records: DataFrame, bounds: DataFrame, shards: int) -> DataFrame:
    """Records whose gid's local number is below their shard's bound; ``bounds``: (shard_id, bound), shards that it lacks show nothing."""
    return records.join(bounds, "shard_id").where(gid_local(F.col("gid"), shards) < F.col("bound")).drop("bound")

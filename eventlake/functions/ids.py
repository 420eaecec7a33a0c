"""Global ids and unsigned numbers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_U64_MAX = Decimal((1 << 64) - 1)


def shard_bits(shards: int) -> int:
    """Low bits of a gid that hold the shard: none for one shard."""
    if shards < 1:
        raise ValueError("a log has one shard at least")
    return (shards - 1).bit_length()


def encode_gid(local: Column, shard: Column, shards: int) -> Column:
    """Global id of a shard's local sequence number."""
    return F.shiftleft(local.cast("long"), shard_bits(shards)).bitwiseOR(shard.cast("long"))


def gid_shard(gid: Column, shards: int) -> Column:
    return gid.bitwiseAND(F.lit((1 << shard_bits(shards)) - 1).cast("long")).cast("int")


def gid_local(gid: Column, shards: int) -> Column:
    return F.shiftrightunsigned(gid, shard_bits(shards))


def u64(value: Column) -> Column:
    """A string as an unsigned 64-bit number (decimal(20,0)): ASCII digits, a plus sign allowed; null for all else and for what is too large."""
    # Leading zeros may make a number longer than the type: they don't count.
    digits = F.regexp_replace(value, r"\A\+?0*(?=[0-9])", "")
    n = F.when(value.rlike(r"\A\+?[0-9]+\z") & (F.length(digits) <= 20), digits.try_cast("decimal(20,0)"))
    return F.when(n <= F.lit(_U64_MAX), n)

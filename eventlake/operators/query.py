"""The structured query: predicates, an anti-join, seven result shapes.

``LogQuery`` says what; ``build`` makes a lazy DataFrame of it.  Event types,
sequence range and promoted metadata columns reach the scan; content is read
only by the shape that returns records.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import u64
from ..schema import PROMOTED
from ..sources.store import stored
from .ranges import number_rows


class Result(Enum):
    RECORDS = "records"
    COUNT = "count"
    EXISTS = "exists"
    COUNT_DISTINCT = "count_distinct"
    MIN = "min"
    MAX = "max"
    DISTINCT_VALUES = "distinct_values"

    @classmethod
    def of(cls, value: object) -> Result:
        """A shape by name; what is unknown is RECORDS."""
        try:
            return value if isinstance(value, cls) else cls(str(value).lower())
        except ValueError:
            return cls.RECORDS


@dataclass(frozen=True)
class AbsentMatch:
    """Drop candidates whose ``join_key`` value some record of ``peer_event_types`` has."""

    peer_event_types: tuple[str, ...]
    join_key: str


@dataclass(frozen=True)
class LogQuery:
    """Predicates are ANDed; no event types means all; both ends of the range belong to it.

    ``field`` is the metadata key that distinct counts, distinct values, minimum
    and maximum are of; without one (or an empty one) they are of seq.
    ``limit`` 0 is no limit, below 0 counts as 0; counts and existence ignore it.
    """

    event_types: tuple[str, ...] = ()
    from_seq: int | None = None
    to_seq: int | None = None
    metadata: Mapping[str, str] = field(default_factory=dict)
    absent: AbsentMatch | None = None
    result: Result = Result.RECORDS
    field: str | None = None
    limit: int = 0
    descending: bool = False


def metadata_value(records: DataFrame, key: str) -> Column:
    """A key's value: of its promoted column where there is one, for only that reaches the scan."""
    name = PROMOTED + key
    return F.col(f"`{name}`") if name in records.columns else F.col("metadata")[key]


def filtered(records: DataFrame, q: LogQuery) -> DataFrame:
    """The records that the predicates of ``q`` keep."""
    out = records
    if q.event_types:
        out = out.where(F.col("event_type").isin(*q.event_types))
    if q.from_seq is not None:
        out = out.where(F.col("seq") >= q.from_seq)
    if q.to_seq is not None:
        out = out.where(F.col("seq") <= q.to_seq)
    for key, value in q.metadata.items():
        out = out.where(metadata_value(records, key) == value)
    return out


def absent(candidates: DataFrame, records: DataFrame, match: AbsentMatch) -> DataFrame:
    """NOT EXISTS: candidates without the key stay; peers come from all of ``records``, whatever the candidates' predicates.

    Peers are reduced to their distinct keys before anything moves, so a key
    that many records have is one row; how to join is decided at run time.
    """
    if not match.peer_event_types:
        return candidates
    peers = (
        records.where(F.col("event_type").isin(*match.peer_event_types))
        .select(metadata_value(records, match.join_key).alias("__peer"))
        .where(F.col("__peer").isNotNull())
        .distinct()
    )
    return candidates.join(peers, metadata_value(candidates, match.join_key) == F.col("__peer"), "left_anti")


def build(records: DataFrame, q: LogQuery) -> DataFrame:
    """The result of ``q`` over one stream's live records.

    RECORDS: the records, in order.  COUNT, COUNT_DISTINCT: ``n``.  EXISTS:
    ``found``.  MIN, MAX: ``value`` (decimal(20,0); 0 where no value is a number).
    DISTINCT_VALUES: ``value`` and ``pos`` from 1, by first occurrence (from the
    last on if descending).
    """
    rows = filtered(records, q)
    if q.absent is not None:
        rows = absent(rows, records, q.absent)
    limit = max(0, q.limit)
    value = metadata_value(records, q.field) if q.field else F.col("seq").cast("string")
    if q.result is Result.COUNT:
        return rows.agg(F.count(F.lit(1)).alias("n"))
    if q.result is Result.EXISTS:
        return rows.select(F.lit(1).alias("one")).limit(1).agg((F.count("one") > 0).alias("found"))
    if q.result is Result.COUNT_DISTINCT:
        return rows.agg(F.count_distinct(value).alias("n"))
    if q.result in (Result.MIN, Result.MAX):
        number = u64(value) if q.field else F.col("seq").cast("decimal(20,0)")
        pick = F.min if q.result is Result.MIN else F.max
        return rows.agg(F.coalesce(pick(number), F.lit(0).cast("decimal(20,0)")).alias("value"))
    if q.result is Result.DISTINCT_VALUES:
        return _distinct_values(rows, value, q.descending, limit)
    out = rows.orderBy(F.col("seq").desc() if q.descending else F.col("seq").asc())
    return out.limit(limit) if limit else out


def _distinct_values(rows: DataFrame, value: Column, descending: bool, limit: int) -> DataFrame:
    first = rows.select(value.alias("value"), "seq").where(F.col("value").isNotNull()).groupBy("value").agg(F.min("seq").alias("first"))
    if limit:
        order = F.col("first").desc() if descending else F.col("first").asc()
        top = first.orderBy(order).limit(limit)  # a bounded number of rows is numbered in one place
        return top.select("value", F.row_number().over(Window.orderBy(order)).cast("long").alias("pos"))
    # Numbering reads its input more than once: the distinct values are stored, for they cost a pass over all records.
    return number_rows(stored(first), "first", descending=descending).select("value", "pos")

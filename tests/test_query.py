"""The structured query: expectations on small logs, and a plain interpreter on random ones."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from eventlake.operators.query import AbsentMatch, LogQuery, Result, build
from eventlake.operators.writer import promote
from eventlake.schema import RECORD_SCHEMA

BASE = [
    (1, "turn_started", {"turn_id": "10"}),
    (2, "llm_invoked", {"turn_id": "10", "step_id": "s1"}),
    (3, "turn_started", {"turn_id": "20"}),
    (4, "tool_invoked", {"turn_id": "20", "step_id": "s2"}),
]
DONE = (5, "turn_completed", {"turn_id": "10"})
KEYLESS = (6, "turn_started", {})
PENDING = AbsentMatch(("turn_completed", "turn_failed"), "turn_id")


def log(spark, rows):
    return spark.createDataFrame(
        [("n", "s", 1, 1, q, q - 1, 0, kind, "application/json", q * 10**9, meta, f"c-{q}".encode(), None) for q, kind, meta in rows], RECORD_SCHEMA
    )


def answer(df, q):
    """The result as a plain value."""
    rows = build(df, q).collect()
    if q.result is Result.RECORDS:
        return [r.seq for r in rows]
    if q.result is Result.DISTINCT_VALUES:
        return [r.value for r in sorted(rows, key=lambda r: r.pos)]
    (row,) = rows
    return int(row[0]) if q.result is not Result.EXISTS else row[0]


CASES = [
    (BASE, LogQuery(("turn_started",)), [1, 3]),
    (BASE, LogQuery(metadata={"turn_id": "20"}), [3, 4]),
    (BASE, LogQuery(from_seq=2, to_seq=3), [2, 3]),
    (BASE, LogQuery(limit=2), [1, 2]),
    (BASE, LogQuery(limit=2, descending=True), [4, 3]),
    (BASE, LogQuery(limit=-3), [1, 2, 3, 4]),
    (BASE, LogQuery(("turn_started",), result=Result.COUNT, limit=1), 2),
    (BASE, LogQuery(("tool_invoked",), result=Result.EXISTS), True),
    (BASE, LogQuery(("nope",), result=Result.EXISTS), False),
    (BASE, LogQuery(("turn_started",), result=Result.COUNT_DISTINCT, field="turn_id"), 2),
    (BASE, LogQuery(result=Result.COUNT_DISTINCT, field="step_id"), 2),
    (BASE, LogQuery(result=Result.MAX, field="turn_id"), 20),
    (BASE, LogQuery(result=Result.MIN, field="turn_id"), 10),
    (BASE, LogQuery(result=Result.MAX, field="nonexistent"), 0),
    (BASE, LogQuery(result=Result.MAX, field="step_id"), 0),
    (BASE, LogQuery(result=Result.MAX), 4),
    (BASE, LogQuery(result=Result.MAX, field=""), 4),
    (BASE, LogQuery(result=Result.DISTINCT_VALUES, field="turn_id"), ["10", "20"]),
    (BASE, LogQuery(result=Result.DISTINCT_VALUES, from_seq=3), ["3", "4"]),
    (BASE, LogQuery(("turn_started",), absent=PENDING), [1, 3]),
    ([*BASE, DONE], LogQuery(("turn_started",), absent=PENDING), [3]),
    (BASE, LogQuery(("turn_started",), absent=PENDING, result=Result.COUNT), 2),
    ([*BASE, KEYLESS], LogQuery(("turn_started",), absent=PENDING, result=Result.COUNT), 3),
    ([*BASE, DONE], LogQuery(("turn_started",), to_seq=4, absent=PENDING), [3]),
    ([*BASE, DONE], LogQuery(("turn_started",), absent=AbsentMatch((), "turn_id")), [1, 3]),
    ([(i, "t", {"turn_id": v}) for i, v in enumerate(["9", "10", "20", "9"], 1)], LogQuery(result=Result.DISTINCT_VALUES, field="turn_id"), ["9", "10", "20"]),
    ([(i, "t", {"turn_id": v}) for i, v in enumerate(["9", "10", "20", "9"], 1)], LogQuery(result=Result.DISTINCT_VALUES, field="turn_id", descending=True), ["20", "10", "9"]),
    ([(i, "t", {"turn_id": v}) for i, v in enumerate(["9", "10", "20"], 1)], LogQuery(result=Result.DISTINCT_VALUES, field="turn_id", descending=True, limit=1), ["20"]),
    (BASE, LogQuery(from_seq=2, result=Result.COUNT), 3),
    ([], LogQuery(result=Result.COUNT), 0),
    ([], LogQuery(result=Result.EXISTS), False),
    ([], LogQuery(result=Result.MAX, field="x"), 0),
    ([], LogQuery(result=Result.COUNT_DISTINCT, field="x"), 0),
    ([], LogQuery(), []),
    ([], LogQuery(result=Result.DISTINCT_VALUES, field="x"), []),
]


@pytest.mark.parametrize("rows,q,want", CASES)
def test_cases(spark, rows, q, want):
    assert answer(log(spark, rows), q) == want


def test_numbers_are_unsigned_64_bit(spark):
    values = [" 5", "1e3", "1.0", "-1", "٣", "18446744073709551616", "7\n", "", "+00012", "18446744073709551615", "0" * 30 + "3"]
    df = log(spark, [(i, "t", {"v": v}) for i, v in enumerate(values, 1)])
    assert answer(df, LogQuery(result=Result.MAX, field="v")) == 18446744073709551615
    assert answer(df, LogQuery(result=Result.MIN, field="v")) == 3


def test_unknown_shape_is_records():
    assert Result.of("nope") is Result.RECORDS and Result.of("COUNT") is Result.COUNT and Result.of(Result.MAX) is Result.MAX


def test_null_metadata_and_promoted_columns(spark, tmp_path):
    df = log(spark, [*BASE, (7, "turn_started", None)])
    assert answer(df, LogQuery(("turn_started",), absent=PENDING)) == [1, 3, 7]
    at = str(tmp_path / "t")
    promote(df, ["turn_id"]).write.parquet(at)
    table = spark.read.parquet(at)
    counted = build(table, LogQuery(metadata={"turn_id": "20"}, result=Result.COUNT))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(md_turn_id,20)" in plan and "content" not in plan.split("ReadSchema")[1]
    assert counted.first()[0] == 2


def interpret(rows, q):
    """The same semantics, one record at a time."""
    kept = [
        r
        for r in sorted(rows, key=lambda r: r[0])
        if (not q.event_types or r[1] in q.event_types)
        and (q.from_seq is None or r[0] >= q.from_seq)
        and (q.to_seq is None or r[0] <= q.to_seq)
        and all((r[2] or {}).get(k) == v for k, v in q.metadata.items())
    ]
    if q.absent:
        peers = {(r[2] or {}).get(q.absent.join_key) for r in rows if r[1] in q.absent.peer_event_types} - {None}
        kept = [r for r in kept if (r[2] or {}).get(q.absent.join_key) not in peers]
    values = [v for v in ((r[2] or {}).get(q.field) if q.field else str(r[0]) for r in kept) if v is not None]
    limit = max(0, q.limit)
    if q.result is Result.RECORDS:
        seqs = [r[0] for r in (kept[::-1] if q.descending else kept)]
        return seqs[:limit] if limit else seqs
    if q.result is Result.DISTINCT_VALUES:
        first = list(dict.fromkeys(values))
        first = first[::-1] if q.descending else first
        return first[:limit] if limit else first
    if q.result is Result.COUNT:
        return len(kept)
    if q.result is Result.EXISTS:
        return bool(kept)
    if q.result is Result.COUNT_DISTINCT:
        return len(set(values))
    numbers = [int(v) for v in values if v.removeprefix("+").isdigit() and v.isascii() and int(v) < 1 << 64]
    return (min if q.result is Result.MIN else max)(numbers, default=0)


_values = st.sampled_from(["1", "2", "+3", "x", "", "9223372036854775808", "18446744073709551616", "007"])
_meta = st.one_of(st.none(), st.dictionaries(st.sampled_from(["a", "b"]), _values, max_size=2))
_rows = st.lists(st.tuples(st.sampled_from(["p", "q", "r"]), _meta), max_size=12)
_queries = st.builds(
    LogQuery,
    event_types=st.lists(st.sampled_from(["p", "q", "z"]), max_size=2).map(tuple),
    from_seq=st.one_of(st.none(), st.integers(0, 12)),
    to_seq=st.one_of(st.none(), st.integers(0, 12)),
    metadata=st.dictionaries(st.sampled_from(["a", "b"]), _values, max_size=1),
    absent=st.one_of(st.none(), st.builds(AbsentMatch, st.lists(st.sampled_from(["q", "r"]), max_size=2).map(tuple), st.sampled_from(["a", "b"]))),
    result=st.sampled_from(list(Result)),
    field=st.sampled_from([None, "a", "b"]),
    limit=st.integers(-1, 4),
    descending=st.booleans(),
)


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=_rows, q=_queries)
def test_random_queries(spark, rows, q):
    numbered = [(i, *r) for i, r in enumerate(rows, 1)]
    random.Random(0).shuffle(numbered)
    assert answer(log(spark, numbered), q) == interpret(numbered, q)

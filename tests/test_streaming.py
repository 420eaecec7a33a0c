"""Streams: in batches and with restarts they deliver what a batch read has."""

import json

import pytest
from pyspark.sql import functions as F

from eventlake.operators.live import live, tombstone_cutoffs
from eventlake.schema import MARKER
from eventlake.streaming import backup, export, tail

from .test_query import log


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, "purchase" if i % 3 == 0 else "click", {"i": str(i)}) for i in range(1, 41)]
    at = str(tmp_path / "table")
    log(spark, rows).repartition(4).write.parquet(at)
    return at


def seqs(spark, at):
    return sorted(r.seq for r in spark.read.parquet(at).select("seq").collect())


def test_tail_resumes_without_gap_or_repeat(spark, table, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    read = lambda: tail.tail(tail.open_stream(spark, table, 1), "n", "s", from_seq=6)
    tail.drain(read(), out, cp)
    assert seqs(spark, out) == list(range(6, 41))
    log(spark, [(i, "click", {}) for i in range(41, 51)]).write.mode("append").parquet(table)
    tail.drain(read(), out, cp)
    assert seqs(spark, out) == list(range(6, 51))


def test_resume_point():
    assert tail.resume_point(0, 7) == 8 and tail.resume_point(3, 7) == 3 and tail.resume_point(0, None) == 0


def test_subscribe(spark, table, tmp_path):
    out = str(tmp_path / "out")
    tail.drain(tail.subscribe(tail.open_stream(spark, table), ["purchase"], 9), out, str(tmp_path / "cp"))
    assert seqs(spark, out) == [i for i in range(10, 41) if i % 3 == 0]
    with pytest.raises(ValueError):
        tail.subscribe(spark.read.parquet(table), [])


def test_consume_joins_static_sides(spark, table, tmp_path):
    assignment = spark.createDataFrame([("g", 0, "m")], "group string, shard long, member string")
    offsets = spark.createDataFrame([("g", 0, 35)], "group string, shard long, seq long")
    out = str(tmp_path / "out")
    tail.drain(tail.consume(tail.open_stream(spark, table), assignment, offsets), out, str(tmp_path / "cp"))
    assert seqs(spark, out) == list(range(36, 41))


def test_live_at_delivery(spark, table, tmp_path):
    log(spark, [(41, MARKER, {}), (42, "click", {})]).write.mode("append").parquet(table)
    cuts = tombstone_cutoffs(spark.read.parquet(table))
    out = str(tmp_path / "out")
    tail.drain(tail.live_at(tail.open_stream(spark, table), cuts), out, str(tmp_path / "cp"))
    assert seqs(spark, out) == [r.seq for r in live(spark.read.parquet(table)).collect()] == [42]


class FileSink:
    """A line of a file for each batch; a token that it has is passed over."""

    def __init__(self, at):
        self.at = at

    def push(self, lines, token):
        import os

        name = os.path.join(self.at, token.replace("/", "_").replace(":", "_"))
        with open(name, "w") as f:
            f.write("\n".join(lines))


def test_export_to_a_sink(spark, table, tmp_path):
    at = tmp_path / "sink"
    at.mkdir()
    for _ in range(2):  # the second run has nothing left, the checkpoint is the progress
        export.export(tail.open_stream(spark, table, 2), export.to_sink(FileSink(str(at)), size=7), str(tmp_path / "cp")).awaitTermination()
    lines = [json.loads(x) for f in at.iterdir() for x in f.read_text().split("\n")]
    assert sorted(x["seq"] for x in lines) == list(range(1, 41)) and set(lines[0]) == {"namespace", "stream", "seq", "event_type", "content_type", "timestamp_ns", "content"}


def test_retry():
    waits, left = [], [3]

    def push():
        if left[0]:
            left[0] -= 1
            raise export.Retriable

    assert export.push_with_retry(push, 1.0, 9, waits.append) == 4 and waits == [1.0, 2.0, 4.0]
    left[0] = 99
    with pytest.raises(export.Retriable):
        export.push_with_retry(push, 1.0, 9, waits.append)
    assert max(waits) <= 60


def test_replication_is_idempotent_and_fenced(spark, table, tmp_path):
    to = str(tmp_path / "standby")
    copy = export.replicate(to, 2, lambda: 2)
    batch = spark.read.parquet(table)
    copy(batch.where("seq <= 30"), 0)
    copy(batch, 1)
    copy(batch.limit(0), 2)
    assert seqs(spark, to) == list(range(1, 41))
    with pytest.raises(PermissionError):
        export.replicate(to, 1, lambda: 2)(batch, 3)
    assert export.acknowledged(2, 3, "quorum") and not export.acknowledged(2, 3, "all") and export.acknowledged(1, 3, 1)


def test_backup(spark, table, tmp_path):
    at, to = str(tmp_path / "backup"), str(tmp_path / "restored")
    backup.backup(spark, table, at)
    assert backup.verify_backup(spark, at).isEmpty()
    assert backup.restore(spark, at, to).first().ok and seqs(spark, to) == list(range(1, 41))
    log(spark, [(99, "t", {})]).write.mode("append").parquet(f"{at}/data")
    assert {r.problem for r in backup.verify_backup(spark, at).collect()} == {"new"}
    with pytest.raises(ValueError):
        backup.restore(spark, at, to)


def test_deliver_remembers(spark, table, tmp_path):
    seen = []
    cp = str(tmp_path / "cp")
    for _ in range(2):
        tail.deliver(tail.open_stream(spark, table).select("seq"), lambda df, i: seen.append(df.agg(F.count("*")).first()[0]), cp).awaitTermination()
    assert sum(seen) == 40

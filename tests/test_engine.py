"""Ids, checksums, names, encryption, tombstones, reads, appends, integrity, retention, consumers."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlake import functions as fn
from eventlake.functions.crypto import encrypt
from eventlake.functions.hashes import blake3_of
from eventlake.operators import catalog, consumers, integrity, live, ranges, retention, writer
from eventlake.operators.query import LogQuery, Result, build
from eventlake.operators.ranges import number_rows, with_previous
from eventlake.plans.queries import QUERIES
from eventlake.schema import MARKER
from eventlake.sources import adapters, envelope, reads, segments, store

from .test_query import log

CHECK = 0xE3069283
DIR = "/root/testdata/sf0.001"


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_crc32c(spark):
    assert list(fn.crc32c_of([b"123456789", b"", None, b"a"])) == [CHECK, 0, 0, 0xC1D04330]
    assert value(spark, fn.crc32c(F.lit("123456789"))) == CHECK


@given(st.integers(1, 64), st.integers(0, 1 << 40))
def test_shard_bits(shards, local):
    bits = fn.shard_bits(shards)
    assert (1 << bits) >= shards and (bits == 0 or (1 << (bits - 1)) < shards)


def test_gid_round_trip(spark):
    for shards in (1, 2, 3, 4, 5, 8):
        df = spark.range(50).select(F.col("id").alias("local"), (F.col("id") % shards).cast("int").alias("shard"))
        df = df.withColumn("gid", fn.encode_gid(F.col("local"), F.col("shard"), shards))
        assert df.where((fn.gid_local(F.col("gid"), shards) != F.col("local")) | (fn.gid_shard(F.col("gid"), shards) != F.col("shard"))).count() == 0
        assert df.select("gid").distinct().count() == 50
    assert fn.shard_bits(1) == 0
    with pytest.raises(ValueError):
        fn.shard_bits(0)


@pytest.mark.parametrize("name,ok", [("a", True), ("a_b-1", True), ("_a", False), ("", False), (None, False), ("A", False), ("a/b", False), ("x" * 64, True), ("x" * 65, False), ("a\n", False)])
def test_namespace_names(spark, name, ok):
    assert value(spark, fn.namespace_ok(F.lit(name).cast("string"))) is ok


@pytest.mark.parametrize("name,ok", [("a/b", True), ("a//b", False), ("/a", False), ("a/", False), ("_a", False), ("x" * 128, True), ("x" * 129, False)])
def test_stream_names(spark, name, ok):
    assert value(spark, fn.stream_ok(F.lit(name))) is ok


def test_encryption(spark):
    keys = [bytes([i]) * 32 for i in range(3)]
    sealed = fn.encrypt(F.lit("plain"), keys[1])
    assert bytes(value(spark, fn.decrypt_with_ring(sealed, keys))) == b"plain"
    assert value(spark, fn.decrypt_with_ring(sealed, [keys[0]])) is None
    assert fn.derive_key(b"s", "a") != fn.derive_key(b"s", "b") and len(fn.derive_key(b"s", "a")) == 32
    masked = fn.xor_mask(F.lit(b"\x00\x01\xff"), b"\x0f\xf0")
    assert bytes(value(spark, masked)) == b"\x0f\xf1\xf0" and bytes(value(spark, fn.xor_mask(masked, b"\x0f\xf0"))) == b"\x00\x01\xff"


def test_tombstones(spark):
    rows = [(1, "t", {}), (2, "t", {}), (3, "t", {}), (4, MARKER, {})]
    assert live.live(log(spark, rows)).count() == 0
    assert [r.seq for r in live.live(log(spark, [*rows, (5, "t", {})])).collect()] == [5]
    assert live.live(log(spark, [])).count() == 0
    usage = retention.quota_usage(log(spark, [*rows, (5, "t", {}), (6, "t", {})])).first()
    assert (usage.n_records, usage.n_bytes) == (2, 6)


def test_boundary(spark):
    df = log(spark, [(i, "t", {}) for i in range(1, 6)])
    bounds = spark.createDataFrame([(0, 3)], "shard_id int, bound long")
    assert sorted(r.seq for r in live.within_boundary(df, bounds, 1).collect()) == [1, 2, 3]
    two = df.withColumns({"shard_id": (F.col("gid") % 2).cast("int")})
    assert sorted(r.gid for r in live.within_boundary(two, bounds, 2).collect()) == [0, 2, 4]


def test_reads(spark):
    df = log(spark, [(i, "t", {}) for i in range(1, 26)])
    got = reads.multi_get(df, [5, 99, 0, 5]).collect()
    assert [(r.pos, r.seq, r.found) for r in got] == [(0, 6, True), (1, None, False), (2, 1, True), (3, 6, True)]
    assert reads.multi_get(df, []).count() == 0
    assert [r.gid for r in reads.scan(df, 3, 6).collect()] == [3, 4, 5]
    pages = reads.scan_pages(df, 3, 10).select("page", "next_seq", "has_more").distinct().orderBy("page").collect()
    assert [tuple(r) for r in pages] == [(0, 13, True), (1, 23, True), (2, 26, False)]
    at = spark.createDataFrame([(0, 4)], "shard_id int, position long")
    seen = []
    for _ in range(4):
        batch, at = reads.tailer_batch(df, at, 1, 8)
        seen += [r.gid for r in batch.collect()]
    assert seen == list(range(4, 25)) and reads.tailer_position(at).first().position == 25
    assert reads.tailer_seek(at, 0).first().position == 0
    assert reads.latest_by_stream(df).first().seq == 25


@pytest.fixture
def partitions(spark):
    """Sets the number of shuffle partitions for one test."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _wide(spark, n):
    return spark.range(n, numPartitions=13).select((F.col("id") * 7919 % n).alias("x"), F.repeat(F.md5(F.col("id").cast("string")), 6).alias("w"))


@pytest.mark.parametrize("n,parts,descending", [(1_000_000, 8, False), (1_000_000, 200, True), (3_000_000, 64, False)])
def test_number_rows_is_exact_and_without_gaps(spark, partitions, n, parts, descending):
    partitions(parts)
    want = F.lit(n) - F.col("x") if descending else F.col("x") + 1
    numbered = number_rows(_wide(spark, n), "x", descending=descending, range_rows=n // 40)
    got = numbered.agg(F.count("w").alias("n"), F.count(F.when(F.col("pos") != want, 1)).alias("wrong")).first()
    assert tuple(got) == (n, 0)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 0


def test_number_rows_in_groups(spark, partitions):
    """A hot group, small ones, one without a name; keys that repeat and null keys: numbers are 1 to the group's size, by key."""
    partitions(16)
    rows = spark.range(60_000, numPartitions=5).select(
        F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") * 37 % 60_013).alias("x"),
        F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("id") % 70).cast("string"))).alias("g"),
        F.col("id").alias("told"),
    )
    numbered = number_rows(rows, "x", ["g"], range_rows=1000, ties=["told"])
    got = {}
    for r in numbered.collect():
        got.setdefault(r.g, []).append((r.pos, -1 if r.x is None else r.x))
    assert sum(map(len, got.values())) == 60_000
    for found in got.values():
        found.sort()
        assert [p for p, _ in found] == list(range(1, len(found) + 1)) and [x for _, x in found] == sorted(x for _, x in found)
    again = numbered.join(number_rows(rows.repartition(9), "x", ["g"], range_rows=1000, ties=["told"]).select("told", F.col("pos").alias("p")), "told")
    assert again.where("pos <> p").count() == 0


def test_with_previous_in_groups(spark):
    rows = spark.range(20_000, numPartitions=5).select((F.col("id") * 37 % 20_011).alias("x"), F.when(F.col("id") % 4 > 0, "hot").otherwise("other").alias("g")).withColumn("v", F.when(F.col("x") % 5 > 0, F.col("x") * 2))
    before, last = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.x):
        before[r.x], last[r.g] = last.get(r.g), r.v
    assert {r.x: r.p for r in with_previous(rows, "v", "x", ["g"], "p", range_rows=700).collect()} == before


def test_pages_of_a_long_stream(spark, partitions):
    partitions(32)
    n = 1_100_000
    rows = spark.range(n, numPartitions=7).select((n - F.col("id")).alias("seq"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("content"))
    pages = reads.scan_pages(rows, 101, 1000).groupBy("page").agg(F.count("content").alias("n"), F.min("seq").alias("low"), F.max("next_seq").alias("next"), F.max("has_more").alias("more")).collect()
    assert sorted((r.page, r.n, r.low, r.next, r.more) for r in pages) == [(k, min(1000, n - 100 - 1000 * k), 101 + 1000 * k, min(n, 1100 + 1000 * k) + 1, k < 1099) for k in range(1100)]
    numbered = writer.assign_seq_single(rows.withColumnRenamed("seq", "arrival"), 10)
    assert tuple(numbered.agg(F.count("*"), F.count(F.when(F.col("seq") != F.col("arrival") + 10, 1))).first()) == (n, 0)


def incoming(spark, rows):
    return spark.createDataFrame([("n", s, "t", None, 0, {"key": k}, b"x", i) for i, (s, k) in enumerate(rows)], "namespace string, stream string, event_type string, content_type string, timestamp_ns long, metadata map<string,string>, content binary, arrival long")


def test_append(spark):
    there = log(spark, [(1, "t", {}), (2, "t", {})])
    new = incoming(spark, [("s", "a"), ("other", "b"), ("s", "c")])
    out = writer.append(new.withColumn("k", F.col("metadata")["key"]), there, 4, key="k")
    got = {(r.stream, r.seq) for r in out.collect()}
    assert got == {("s", 3), ("s", 4), ("other", 1)}
    assert all(r.shard_id == fn.crc32c_of([r.metadata["key"].encode()])[0] % 4 and r.gid & 3 == r.shard_id and r.content_type == "application/json" and r.timestamp_ns > 0 for r in out.collect())
    with pytest.raises(ValueError):
        writer.batch_append(new, there, 4)
    assert writer.batch_append(new.limit(0), there, 4).count() == 0
    quotas = spark.createDataFrame([("n", "s", 3, None)], "namespace string, stream string, max_records long, max_bytes long")
    assert writer.batch_append(incoming(spark, [("s", "a")]), there, 4, quotas).count() == 1
    with pytest.raises(PermissionError):
        writer.batch_append(incoming(spark, [("s", "a"), ("s", "b")]), there, 4, quotas)
    marked = there.unionByName(writer.delete_stream(there, "n", "s", 1), allowMissingColumns=True)
    assert live.live(marked).count() == 0


def test_validation_splits(spark):
    rows = incoming(spark, [("s", "a"), ("_bad", "b")]).withColumn("metadata", F.when(F.col("arrival") == 0, F.col("metadata")))
    ok, bad = writer.split_valid(rows)
    assert ok.count() == 1 and [r.rejected for r in bad.collect()] == ["stream"]


def test_chains(spark):
    df = log(spark, [(i, "t", {}) for i in range(1, 21)])
    built = integrity.build_hashes(df).orderBy("gid").collect()
    link = bytes(32)
    for r in built:
        link = hashlib.sha256(link + bytes(r.content)).digest()
        assert bytes(r.hash_n) == link
    again = integrity.build_hashes(df)
    assert integrity.broken_links(again).first().ok
    tampered = again.withColumn("content", F.when(F.col("gid") == 7, F.lit(b"X")).otherwise(F.col("content")))
    assert tuple(integrity.broken_links(tampered).select("ok", "first_broken").first()) == (False, 7)
    for seqs, want in (([1, 2, 4], 3), ([3, 7, 7], 4), ([2, 4, 6, 6, 7], 3), ([5, 6, 7], 0), ([1, 1, 2], 2)):
        row = integrity.verify_chain(log(spark, [(s, "t", {}) for s in seqs])).first()
        assert (row.ok, row.error_at_seq, row.verified_from, row.verified_to) == (want == 0, want, seqs[0], seqs[-1])


def test_recovery_report_counts_all_shards(spark):
    df = spark.createDataFrame([(s, (n << 2) | s, 1) for s, size in ((0, 5), (1, 3), (3, 9)) for n in range(size)], "shard_id int, gid long, seq long")
    for checkpoint in (0, 1, 7, 12, 100):
        row = catalog.recovery_report(df, 4, checkpoint).first()
        assert row.n_records == df.where(F.col("gid") >= checkpoint).count() and row.to_sequence == 2


def test_retention(spark):
    seg = spark.createDataFrame([(0, i, i * 10, 100, i) for i in range(1, 6)], "shard_id int, segment_id long, base_seq long, bytes long, modified_ns long")
    ids = lambda df: sorted(r.segment_id for r in df.collect())
    assert ids(retention.retain_max_bytes(seg, 250)) == [1, 2, 3]
    assert ids(retention.retain_max_bytes(seg, 0)) == [1, 2, 3, 4] and ids(retention.retain_max_bytes(seg, 500)) == []
    assert ids(retention.retain_max_age(seg, 6, 4)) == [1, 2] and ids(retention.retain_max_age(seg, 100, 1)) == [1, 2, 3, 4]
    assert ids(retention.truncate_before(seg, 30)) == [1, 2] and ids(retention.truncate_before(seg, 29)) == [1]


def test_offset_fold_and_snapshot(spark):
    one = '{"ns":"n","stream":"s","group":"g","shard":%d,"seq":%d}'
    rows = [(1, "offset_committed", one % (0, 9)), (2, "offset_snapshot", "[" + one % (0, 5) + "]"), (3, "offset_committed", one % (0, 4)), (4, "offset_committed", one % (1, 7)), (5, "offset_committed", "no json"), (6, "other", one % (0, 99))]
    folded = consumers.fold_offsets(spark.createDataFrame(rows, "seq long, event_type string, content string"))
    state = {(r.shard, r.seq) for r in folded.collect()}
    assert state == {(0, 5), (1, 7)}
    snap = consumers.snapshot_event(folded).first()
    again = consumers.fold_offsets(spark.createDataFrame([(1, snap.event_type, snap.content)], "seq long, event_type string, content string"))
    assert {(r.shard, r.seq) for r in again.collect()} == state


def test_offsets_overwrite_or_rise(spark):
    c = spark.createDataFrame([("g", 5, 1), ("g", 3, 2)], "group string, committed long, commit_no long")
    assert consumers.latest_offsets(c, ["group"]).first().committed == 3 and consumers.shard_offsets(c, ["group"]).first().committed == 5


def test_leaders(spark):
    claims = spark.createDataFrame([("g", "a", 1, 100), ("g", "b", 2, 50)], "group string, broker_id string, epoch long, timestamp_ms long")
    top = consumers.pick_leaders(claims, 60, 20).first().asDict()
    assert (top["broker_id"], top["fresh"]) == ("b", True)
    assert consumers.leader_decision(top, "b") == ("leader", 2) and consumers.leader_decision(top, "a") == ("standby", 2)
    assert consumers.leader_decision({**top, "fresh": False}, "a") == ("claim", 3) and consumers.leader_decision(None, "a") == ("claim", 1)


@given(st.integers(0, 20), st.lists(st.tuples(st.booleans(), st.integers(0, 5)), max_size=25))
def test_sticky_assignment(shards, steps):
    g = consumers.Group(shards)
    for joins, who in steps:
        member, before, n = f"m{who}", {m: set(s) for m, s in g.assigned.items()}, g.generation
        known = member in g.members
        g.join(member) if joins else g.leave(member)
        assert g.generation == n + (known != joins)
        held = [s for m in g.members for s in g.assigned[m]]
        assert sorted(held) == (list(range(shards)) if g.members else [])
        sizes = [len(g.assigned[m]) for m in g.members]
        assert not sizes or max(sizes) - min(sizes) <= 1
        for m in g.members:  # nobody gives up more than the quota asks for
            kept = len(before.get(m, set()) & set(g.assigned[m]))
            assert kept == min(len(before.get(m, set())), g.quotas()[m])


def test_segment_files(spark, tmp_path):
    whole = segments.pack_header(0, 1) + b"".join(segments.pack_record(i, i * 10, f"c{i}".encode()) for i in range(5))
    (tmp_path / "segment-00000001.log").write_bytes(whole)
    (tmp_path / "segment-00000002.log").write_bytes(segments.pack_header(5, 2) + segments.pack_record(5, 50, b"ok") + segments.pack_record(6, 60, b"cut")[:-3])
    bad = bytearray(segments.pack_header(7, 3) + segments.pack_record(7, 70, b"flip"))
    bad[-40] ^= 1
    (tmp_path / "segment-00000003.log").write_bytes(bytes(bad))
    (tmp_path / "segment-00000004.log").write_bytes(b"short")
    (tmp_path / "segment-00000005.log").write_bytes(segments.pack_header(0, 5) + bytes(64))
    rows = segments.read_segments(spark, str(tmp_path)).collect()
    good = sorted(r.sequence for r in rows if r.corrupt is None)
    assert good == [0, 1, 2, 3, 4, 5]
    assert sorted(r.corrupt for r in rows if r.corrupt) == ["header is cut off", "record checksum", "record is cut off"]
    assert {bytes(r.content) for r in rows if r.segment_id == 1} == {f"c{i}".encode() for i in range(5)}


def test_records_after_a_damaged_length(spark, tmp_path, monkeypatch):
    """Every byte of the middle record's lengths damaged in turn: the records around it are found, also across search blocks."""
    records = [segments.pack_record(i, i * 10, f"c{i}".encode() * (i + 1)) for i in range(5)]
    head, at = segments.pack_header(0, 1), len(records[0] + records[1])
    raw = b"".join(records)
    for block in (7, 1 << 20):
        monkeypatch.setattr(segments, "_SEARCH", block)
        for k in [*range(4), *range(20, 24)]:
            for flip in (0x01, 0x80, 0xFF):
                bad = bytearray(head + raw + bytes(50))
                bad[len(head) + at + k] ^= flip
                rows = segments.parse("f", bytes(bad))
                assert [r[3] for r in rows if r[-1] is None] == [0, 1, 3, 4], (block, k, flip)
                assert [r[-1] for r in rows if r[-1]] in (["record length"], ["content length"])
    monkeypatch.undo()
    # brute force: the first offset from which a record can be cut out and packed to the same bytes
    noisy = bytes(range(256)) * 3 + records[3] + b"\x01" * 90 + records[4][:-1]
    same = [i for i in range(len(noisy)) if noisy[i:].startswith(records[3])]
    assert segments.next_record(noisy, 0) == same[0] and segments.next_record(noisy, same[0] + 1) is None
    assert segments.next_record(b"", 0) is None and segments.next_record(records[0], 0) == 0
    # the whole stretch of several damaged records is one row, in a file and in a compressed frame
    lost = bytearray(raw)
    lost[at : at + 4] = b"\xff" * 4
    lost[at + len(records[2]) : at + len(records[2]) + 4] = b"\x01\0\0\0"
    (tmp_path / "segment-1.log").write_bytes(head + bytes(lost))
    (tmp_path / "segment-2.log").write_bytes(segments.pack_header(0, 2, flags=4) + segments.pack_frame(bytes(lost)))
    rows = segments.read_segments(spark, str(tmp_path)).collect()
    for segment in (1, 2):
        mine = [r for r in rows if r.segment_id == segment]
        assert sorted(r.sequence for r in mine if r.corrupt is None) == [0, 1, 4]
        assert [r.corrupt for r in mine if r.corrupt] == ["record length"]


def test_framed_segment_files(spark, tmp_path):
    """Compressed, encrypted and both; a key that was rotated out still opens its frames, a missing one is reported."""
    old, new = bytes(range(32)), bytes(range(1, 33))
    record = lambda i: segments.pack_record(i, i * 10, f"c{i}".encode() * 50)
    sealed = lambda raw, key: bytes(spark.range(1).select(encrypt(F.lit(raw), key)).first()[0])
    zipped = lambda raw: segments.pack_frame(raw)[8:]
    frame = lambda payload, raw: len(payload).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + payload
    files = [
        segments.pack_header(0, 1, flags=4) + segments.pack_frame(record(0) + record(1)) + segments.pack_frame(record(2)) + bytes(100),
        segments.pack_header(3, 2, flags=8) + frame(sealed(record(3), old), record(3)) + frame(sealed(record(4), new), record(4)),
        segments.pack_header(5, 3, flags=12) + frame(sealed(zipped(record(5)), new), record(5)) + frame(sealed(zipped(record(6)), b"k" * 32), record(6)),
        segments.pack_header(7, 4, flags=4) + segments.pack_frame(record(7)) + segments.pack_frame(record(8))[:-2],
        segments.pack_header(9, 5, flags=4) + frame(b"junk", record(9)) + frame(zipped(record(10)), record(10) + b"x"),
    ]
    for k, data in enumerate(files):
        (tmp_path / f"segment-{k}.log").write_bytes(data)
    rows = segments.read_segments(spark, str(tmp_path), [new, old]).collect()
    assert sorted((r.sequence, bytes(r.content)) for r in rows if r.corrupt is None) == [(i, f"c{i}".encode() * 50) for i in (0, 1, 2, 3, 4, 5, 7)]
    wrong = sorted((r.segment_id, r.corrupt) for r in rows if r.corrupt)
    assert wrong == [(3, "no key opens the frame"), (4, "frame is cut off"), (5, "frame does not decompress"), (5, "frame length")]
    assert sum(r.corrupt == "no key opens the frame" for r in segments.read_segments(spark, str(tmp_path)).collect()) == 4
    assert [r[3] for r in segments.parse("f", files[0])] == [0, 1, 2]


def test_envelopes(spark, tmp_path):
    whole = envelope.pack(7, 1 << 40, 3, "step", "application/json", {"b": "2", "a": "é"}, 99, b"\x00body")
    assert envelope.unpack(whole) == (7, 1 << 40, 3, "step", "application/json", {"a": "é", "b": "2"}, 99, b"\x00body")
    for cut in range(len(whole)):
        with pytest.raises(envelope.Malformed):
            envelope.unpack(whole[:cut])
    with pytest.raises(ValueError):
        envelope.pack(1, 1, 1, "e", "c", {str(i): "" for i in range(17)}, 0, b"")
    contents = [whole, envelope.pack(1, 1, 1, "", "", {}, 0, b""), b"plain", whole[:20]]
    (tmp_path / "segment-1.log").write_bytes(segments.pack_header(0, 1) + b"".join(segments.pack_record(i, i, c) for i, c in enumerate(contents)))
    rows = sorted(envelope.decode(segments.read_segments(spark, str(tmp_path))).collect(), key=lambda r: r.sequence)
    assert (rows[0].stream_id, rows[0].seq, rows[0].metadata, bytes(rows[0].user_content)) == (1 << 40, 3, {"a": "é", "b": "2"}, b"\x00body")
    assert (rows[1].event_type, rows[1].metadata, bytes(rows[1].user_content), rows[1].corrupt) == ("", {}, b"", None)
    assert [(r.seq, r.corrupt) for r in rows[2:]] == [(None, "envelope is cut off"), (None, "envelope is cut off")]
    assert envelope.decode(segments.read_segments(spark, str(tmp_path)).limit(0)).count() == 0


def test_blake3():
    """The published test vectors (bytes 0 to 250, repeated), and inputs side by side as each alone."""
    data = bytes(i % 251 for i in range(40_000))
    known = {
        0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
        1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
        1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
        1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    }
    assert [h.hex() for h in blake3_of([data[:n] for n in known])] == list(known.values())
    key = b"whats the Elvish word for friend"
    assert blake3_of([None], key)[0].hex() == "92b2b75604ed3c761f9d6f62392c8a9227ad0ea3f09573e783f1498a4ed60d26"
    sizes = [0, 63, 64, 65, 1023, 1024, 2048, 2049, 3072, 5000, 7168, 8193, 31_744, 40_000]
    assert blake3_of([data[:n] for n in sizes], key) == [blake3_of([data[:n]], key)[0] for n in sizes]
    assert len(set(blake3_of([data[:n] for n in sizes]))) == len(sizes)
    assert blake3_of([]) == []


def test_keyed_chains(spark):
    """Links of a stream of one shard by hand; chains don't depend on how rows are dealt into batches."""
    key = bytes(range(32))
    rows = [(s, i, f"{s}-{i}".encode() * (i % 3)) for s in range(5) for i in range(s * 4)]
    df = spark.createDataFrame(rows, "shard_id int, gid long, content binary")
    want, last = {}, {}
    for s, i, c in rows:
        last[s] = want[s, i] = blake3_of([last.get(s, key) + c], key)[0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        built = integrity.build_hashes(df, key=key)
        assert {(r.shard_id, r.gid): bytes(r.hash_n) for r in built.collect()} == want
        assert all(r.ok for r in integrity.broken_links(built, key=key).collect())
        sha = {}
        for s, i, c in rows:
            sha[s, i] = hashlib.sha256(sha.get((s, i - 1), bytes(32)) + c).digest()
        assert {(r.shard_id, r.gid): bytes(r.hash_n) for r in integrity.build_hashes(df).collect()} == sha
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    changed = built.withColumn("content", F.when((F.col("shard_id") == 3) & (F.col("gid") == 5), F.lit(b"no")).otherwise(F.col("content")))
    assert {r.shard_id: (r.ok, r.first_broken) for r in integrity.broken_links(changed, key=key).collect()}[3] == (False, 5)
    assert not any(r.ok for r in integrity.broken_links(built, key=b"k" * 32).collect())


def test_catalog(spark):
    df = log(spark, [(1, "t", {}), (2, "t", {})]).unionByName(log(spark, [(1, "t", {})]).withColumn("namespace", F.lit("_meta")))
    assert [tuple(r) for r in catalog.list_namespaces(df).collect()] == [("n", 1)]
    assert catalog.next_seq(df).where("namespace = 'n'").first().next_seq == 3
    kv = spark.createDataFrame([(1, "PUT a 1"), (2, "PUT b 2"), (3, "DEL a"), (4, "PUT b x y"), (5, "junk"), (6, None)], "seq long, text string")
    assert [tuple(r) for r in catalog.kv_replay(kv).collect()] == [("b", "x y")]


def test_adapters_have_the_record_columns(spark):
    d = "/root/testdata/sf0.001"
    for make, name in ((adapters.events_log, "events"), (adapters.events_by_user, "events"), (adapters.conversations_log, "conversations"), (adapters.lineitem_log, "lineitem"), (adapters.orders_log, "orders")):
        got = make(spark.read.parquet(f"{d}/{name}.parquet"))
        assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [(f.name, f.dataType.simpleString()) for f in log(spark, []).schema], name


def test_single_stream_query_returns_every_row(spark):
    rows = QUERIES["append_single_stream"](spark, DIR).collect()
    assert sorted(r.seq for r in rows) == list(range(1, spark.read.parquet(f"{DIR}/events.parquet").count() + 1))


def test_round_robin_query_has_groups_of_more_members_than_shards(spark):
    at = "/root/testdata/sf0.01"
    joined: dict[int, dict[int, int]] = {}
    for r in spark.read.parquet(f"{at}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        group = joined.setdefault(r.o_custkey % 20, {})
        group[r.o_custkey] = min(r.o_orderkey, group.get(r.o_custkey, r.o_orderkey))
    assert min(map(len, joined.values())) > 16
    want = {(g, i, c) for g, m in joined.items() for i, c in enumerate(sorted(m, key=lambda c: (m[c], c))[:16])}
    rows = QUERIES["assign_round_robin"](spark, at).collect()
    assert len(rows) == len(want) and {(r.group, r.shard, r.member) for r in rows} == want


@pytest.fixture(scope="module")
def stored_log(spark, tmp_path_factory):
    """A record table of 20,000 events in four shards, as a query would find it."""
    at = str(tmp_path_factory.mktemp("table") / "records")
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    writer.write(writer.promote(adapters.events_by_user(events), ["k"]), at, rows_per_file=500)
    return store.open_table(spark, at, ["k"])


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "read,pushed",
    [
        (lambda t: reads.scan(t, 100, 200), ["GreaterThanOrEqual(gid,100)", "LessThan(gid,200)"]),
        (lambda t: reads.read_gid(t, 42), ["EqualTo(gid,42)"]),
        (lambda t: reads.multi_get(t, [5, 9]), ["GreaterThanOrEqual(gid,5)", "LessThanOrEqual(gid,9)"]),
        (lambda t: reads.scan_shard(t, 2, 100), ["GreaterThanOrEqual(gid,100)"]),
        (lambda t: reads.scan_stream(t, "fixture", "user-7", 5), ["EqualTo(stream,user-7)", "GreaterThanOrEqual(seq,5)"]),
        (lambda t: build(t, LogQuery(("click",), from_seq=3, to_seq=9)), ["EqualTo(event_type,click)", "GreaterThanOrEqual(seq,3)", "LessThanOrEqual(seq,9)"]),
        (lambda t: build(t, LogQuery(metadata={"k": "4"}, result=Result.COUNT)), ["EqualTo(md_k,4)"]),
    ],
)
def test_filters_reach_the_stored_table(stored_log, read, pushed):
    plan = _plan(read(stored_log))
    assert "Window" not in plan
    scan = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert all(p in scan for p in pushed), scan


def test_stored_table_prunes(spark, stored_log):
    assert "(shard_id" in _plan(reads.scan_shard(stored_log, 2)).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "content" not in _plan(build(stored_log, LogQuery(("click",), result=Result.COUNT))).split("ReadSchema")[1]
    # Gids rise through a shard's files, which don't overlap.
    files = stored_log.groupBy("shard_id", F.input_file_name().alias("f")).agg(F.min("gid").alias("a"), F.max("gid").alias("b")).orderBy("shard_id", "a").collect()
    assert len(files) > 8 and all(x.shard_id != y.shard_id or x.b < y.a for x, y in zip(files, files[1:]))
    assert stored_log.count() == spark.read.parquet("/root/testdata/sf0.01/events.parquet").count()


def test_live_count_of_a_deletion(spark):
    rows = log(spark, [(1, "t", {}), (2, MARKER, {}), (3, "t", {}), (4, "t", {})])
    assert writer.live_count(rows, "n", "s").first().n == 2 and writer.live_count(rows, "n", "none").first().n == 0


def test_hot_chains_are_checked_in_ranges(spark, monkeypatch):
    """A stream and a shard far larger than a range: gaps, repeats and broken links are found where they are."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    monkeypatch.setattr(ranges.with_previous, "__defaults__", (50,))
    seqs = [*range(1, 700), *range(701, 1200), 1199, *range(1200, 2000)]
    assert tuple(integrity.verify_chain(log(spark, [(q, "t", {}) for q in seqs])).select("ok", "error_at_seq", "verified_to", "n_records").first()) == (False, 700, 1999, len(seqs))
    assert integrity.verify_chain(log(spark, [(q, "t", {}) for q in range(5, 2000)])).first().ok
    built = integrity.build_hashes(log(spark, [(i, "t", {}) for i in range(1, 1001)]))
    assert integrity.broken_links(built).first().ok
    changed = built.withColumn("content", F.when(F.col("gid").isin(500, 900), F.lit(b"X")).otherwise(F.col("content")))
    assert tuple(integrity.broken_links(changed).select("ok", "first_broken").first()) == (False, 500)
    assert integrity.verify_hashes(changed).where("NOT linked").count() == 2

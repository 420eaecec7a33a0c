"""Queries by name: a plan on the fixture tables and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decrypt_with_ring, encode_gid, encrypt, gid_local, gid_shard, rejection
from ..operators import catalog, consumers, integrity, live, retention, writer
from ..operators.query import AbsentMatch, LogQuery, Result, build, metadata_value
from ..schema import MARKER, PROMOTED
from ..sources import adapters, reads, store
from ..streaming import backup, export, tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a plan under its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Metadata keys of the events that are columns of the stored tables.
KEYS = ["k", "user_id", "user_day"]
_STORED: dict[tuple[str, str, str], str] = {}


def _record_table(spark: SparkSession, sf_dir: str, kind: str, make: Callable[[DataFrame], DataFrame]) -> str:
    """Where the record table of the events is that ``make`` defines: written by the first query of an application that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _STORED or not store.exists(spark, _STORED[key]):
        events = _table(spark, sf_dir, "events")
        at = store.new_path(spark, f"records-{kind}")
        # A few files at least, so that a stream over the table has several batches.
        writer.write(writer.promote(make(events), KEYS), at, rows_per_file=max(1, events.count() // 4))
        _STORED[key] = at
    return _STORED[key]


def _open(spark: SparkSession, at: str) -> DataFrame:
    return store.open_table(spark, at, KEYS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open(spark, _record_table(spark, sf_dir, "events", adapters.events_log))


def _by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open(spark, _record_table(spark, sf_dir, "by_user", adapters.events_by_user))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.conversations_log(_table(spark, sf_dir, "conversations"))


#: The events log, and the log of a stream for each user, in SQL.
R = """with r as (select event_id + 1 as seq, event_type, user_id, json_extract_string(props, '$.k') as k,
 user_id::varchar || '|' || ts::date::varchar as user_day, epoch_ns(ts) as timestamp_ns, props from events) """
U = """with u as (select *, local * 4 + shard_id as gid, 'user-' || user_id::varchar as stream from (
 select event_id, user_id, event_type, props, epoch_ns(ts) as timestamp_ns, (user_id % 4)::integer as shard_id,
 row_number() over (partition by user_id % 4 order by event_id) - 1 as local,
 row_number() over (partition by user_id order by event_id) as seq from events)) """
SHARDS = adapters.SHARDS


# --- the structured query


def _shown(df: DataFrame) -> DataFrame:
    return df.select("seq", "event_type", metadata_value(df, "k").alias("k"), metadata_value(df, "user_day").alias("user_day"), "timestamp_ns")


_SHOWN = "select seq, event_type, k, user_day, timestamp_ns from r "


@query(R + _SHOWN + "order by seq limit 25")
def q_records_asc_limit(spark, sf_dir):
    return _shown(build(_events(spark, sf_dir), LogQuery(limit=25)))


@query(R + _SHOWN + "where event_type = 'click' order by seq desc limit 25")
def q_records_desc_limit(spark, sf_dir):
    return _shown(build(_events(spark, sf_dir), LogQuery(("click",), limit=25, descending=True)))


@query(R + _SHOWN + "where event_type in ('click', 'purchase')")
def q_event_in(spark, sf_dir):
    return _shown(build(_events(spark, sf_dir), LogQuery(("click", "purchase"))))


@query(R + _SHOWN + "where seq between 100 and 200")
def q_seq_range_inclusive(spark, sf_dir):
    return _shown(build(_events(spark, sf_dir), LogQuery(from_seq=100, to_seq=200)))


@query(R + _SHOWN + "where k = '4'")
def q_metadata_eq(spark, sf_dir):
    return _shown(build(_events(spark, sf_dir), LogQuery(metadata={"k": "4"})))


@query(R + _SHOWN + "where k = '4' and user_id = 7 or k = '4' and user_id = 7 and seq > 0")
def q_metadata_and(spark, sf_dir):
    return _shown(build(_events(spark, sf_dir), LogQuery(metadata={"k": "4", "user_id": "7"})))


def _some_keyless(records: DataFrame, key: str, every: int) -> DataFrame:
    """Records of which every so many-th lacks the key; it is in the map alone."""
    records = records.drop(PROMOTED + key)
    without = F.map_filter("metadata", lambda k, v: k != key)
    return records.withColumn("metadata", F.when((F.col("seq") - 1) % every == 0, without).otherwise(F.col("metadata")))


@query(R + "select seq, event_type from r where k = '4' and (seq - 1) % 7 <> 0")
def q_metadata_missing_key(spark, sf_dir):
    return build(_some_keyless(_events(spark, sf_dir), "k", 7), LogQuery(metadata={"k": "4"})).select("seq", "event_type")


@query(R + "select count(*) as n from r where event_type = 'click' and k = '4'")
def q_count(spark, sf_dir):
    return build(_events(spark, sf_dir), LogQuery(("click",), metadata={"k": "4"}, result=Result.COUNT, limit=1))


@query(R + "select count(*) > 0 as found from r where event_type = 'signup'")
def q_exists_true(spark, sf_dir):
    return build(_events(spark, sf_dir), LogQuery(("signup",), result=Result.EXISTS))


@query(R + "select count(*) > 0 as found from r where event_type = 'nope'")
def q_exists_false(spark, sf_dir):
    return build(_events(spark, sf_dir), LogQuery(("nope",), result=Result.EXISTS))


@query(R + "select count(distinct user_day) as n from r where event_type = 'purchase'")
def q_count_distinct_field(spark, sf_dir):
    return build(_events(spark, sf_dir), LogQuery(("purchase",), result=Result.COUNT_DISTINCT, field="user_day"))


@query(R + "select count(distinct seq) as n from r where seq >= 11")
def q_count_distinct_seq(spark, sf_dir):
    return build(_events(spark, sf_dir), LogQuery(from_seq=11, result=Result.COUNT_DISTINCT))


_DISTINCT = "select k as value, row_number() over (order by f {0}) as pos from (select k, min(seq) as f from r {1} group by k)"


@query(R + _DISTINCT.format("asc", ""))
def q_distinct_values_asc(spark, sf_dir):
    return build(_events(spark, sf_dir), LogQuery(result=Result.DISTINCT_VALUES, field="k"))


@query(R + "select * from (" + _DISTINCT.format("desc", "where event_type = 'view'") + ") where pos <= 10")
def q_distinct_values_desc_limit(spark, sf_dir):
    return build(_events(spark, sf_dir), LogQuery(("view",), result=Result.DISTINCT_VALUES, field="k", descending=True, limit=10))


def _number(df: DataFrame) -> DataFrame:
    return df.select(F.col("value").cast("long").alias("value"))


_U64 = "case when regexp_full_match({0}, '\\+?[0-9]+') then try_cast({0} as ubigint) end"


@query(R + f"select coalesce(min({_U64.format('k')}), 0)::bigint as value from r where seq >= 50")
def q_min_numeric(spark, sf_dir):
    return _number(build(_events(spark, sf_dir), LogQuery(from_seq=50, result=Result.MIN, field="k")))


@query(R + f"select coalesce(max({_U64.format('k')}), 0)::bigint as value from r where event_type = 'error'")
def q_max_numeric(spark, sf_dir):
    return _number(build(_events(spark, sf_dir), LogQuery(("error",), result=Result.MAX, field="k")))


@query("select 0::bigint as value")
def q_max_missing_is_zero(spark, sf_dir):
    return _number(build(_events(spark, sf_dir), LogQuery(result=Result.MAX, field="nonexistent")))


@query(R + "select max(seq) as value from r where event_type = 'click'")
def q_max_seq(spark, sf_dir):
    return _number(build(_events(spark, sf_dir), LogQuery(("click",), result=Result.MAX)))


_MIXED = "case seq % 6 when 0 then ' 5' when 1 then '1e3' when 2 then '-1' when 3 then '99999999999999999999' when 4 then '+00' || seq::varchar else seq::varchar || chr(10) end"


@query(R + f", m as (select event_type, {_MIXED} as v from r) select event_type, coalesce(min({_U64.format('v')}), 0)::bigint as low, coalesce(max({_U64.format('v')}), 0)::bigint as high from m group by event_type")
def q_min_max_mixed_values(spark, sf_dir):
    from ..functions import u64

    text = F.col("seq").cast("string")
    case = F.col("seq") % 6
    v = (
        F.when(case == 0, F.lit(" 5")).when(case == 1, F.lit("1e3")).when(case == 2, F.lit("-1")).when(case == 3, F.lit("99999999999999999999"))
        .when(case == 4, F.concat(F.lit("+00"), text)).otherwise(F.concat(text, F.lit("\n")))
    )
    n = _events(spark, sf_dir).select("event_type", u64(v).alias("n"))
    zero = F.lit(0).cast("decimal(20,0)")
    return n.groupBy("event_type").agg(F.coalesce(F.min("n"), zero).cast("long").alias("low"), F.coalesce(F.max("n"), zero).cast("long").alias("high"))


_ABSENT = "not exists (select 1 from r p where p.event_type = 'purchase' and p.user_day = a.user_day)"
_MATCH = AbsentMatch(("purchase",), "user_day")


@query(R + f"select seq, event_type, k, user_day, timestamp_ns from r a where event_type = 'click' and {_ABSENT}")
def q_absent_records(spark, sf_dir):
    return _shown(build(_events(spark, sf_dir), LogQuery(("click",), absent=_MATCH)))


@query(R + f"select count(*) as n from r a where event_type = 'click' and {_ABSENT}")
def q_absent_count(spark, sf_dir):
    return build(_events(spark, sf_dir), LogQuery(("click",), absent=_MATCH, result=Result.COUNT))


@query(R.replace("user_id::varchar || '|' || ts::date::varchar", "case when event_id % 7 <> 0 then user_id::varchar || '|' || ts::date::varchar end") + f"select count(*) as n from r a where event_type = 'click' and {_ABSENT}")
def q_absent_missing_key_kept(spark, sf_dir):
    return build(_some_keyless(_events(spark, sf_dir), "user_day", 7), LogQuery(("click",), absent=_MATCH, result=Result.COUNT))


@query(R + f"select count(*) as n from r a where event_type = 'click' and seq between 1 and 100 and {_ABSENT}")
def q_absent_peer_outside_seq_range(spark, sf_dir):
    return build(_events(spark, sf_dir), LogQuery(("click",), from_seq=1, to_seq=100, absent=_MATCH, result=Result.COUNT))


@query("select a.conv_id, a.turn + 1 as seq from conversations a where role = 'user' and not exists (select 1 from conversations p where p.role = 'system' and p.conv_id = a.conv_id)")
def q_absent_conversations(spark, sf_dir):
    out = build(_conversations(spark, sf_dir), LogQuery(("user",), absent=AbsentMatch(("system",), "conv_id")))
    return out.select(F.col("metadata")["conv_id"].cast("long").alias("conv_id"), "seq")


@query("select o_orderkey + 1 as seq, o_orderstatus as event_type from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F' order by 1 limit 50")
def q_orders_promoted_key(spark, sf_dir):
    records = writer.promote(adapters.orders_log(_table(spark, sf_dir, "orders")), ["priority"])
    return build(records, LogQuery(("F",), metadata={"priority": "1-URGENT"}, limit=50)).select("seq", "event_type")


# --- tombstones

_CUT = ", cut as (select user_id, max(seq) as cutoff from u where event_type = 'signup' and user_id % 3 = 0 group by user_id) "


def _marked(events: DataFrame) -> DataFrame:
    marks = (F.col("event_type") == "signup") & ((F.col("stream_id") - 1) % 3 == 0)
    return adapters.events_by_user(events).withColumn("event_type", F.when(marks, MARKER).otherwise(F.col("event_type")))


def _tombstoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open(spark, _record_table(spark, sf_dir, "tombstoned", _marked))


@query(U + _CUT + "select 'fixture' as namespace, 'user-' || user_id::varchar as stream, cutoff from cut")
def tombstone_cutoffs(spark, sf_dir):
    return live.tombstone_cutoffs(_tombstoned(spark, sf_dir))


@query(U + _CUT + "select count(*) as n from u left join cut using (user_id) where seq > coalesce(cutoff, 0)")
def live_view_count(spark, sf_dir):
    return live.live(_tombstoned(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query(U + _CUT + "select stream, count(*) as n, min(seq) as first_seq from u join cut using (user_id) where seq > cutoff group by stream")
def tombstone_then_recreate(spark, sf_dir):
    marked = _tombstoned(spark, sf_dir)
    deleted = live.tombstone_cutoffs(marked)
    kept = live.live(marked, deleted).join(deleted.select("stream"), "stream", "left_semi")
    return kept.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


# --- reads


@query(R + """, p as (select seq, (row_number() over (order by seq) - 1) // 1000 as page from r where seq >= 101)
select page, count(*) as n, min(seq) as first_seq, max(seq) + 1 as next_seq, page < max(page) over () as has_more from p group by page""")
def scan_pages(spark, sf_dir):
    pages = reads.scan_pages(_events(spark, sf_dir), from_seq=101, page_rows=1000)
    return pages.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("next_seq").alias("next_seq"), F.max("has_more").alias("has_more"))


@query(U + "select gid, shard_id, stream, seq from u where gid >= 1000 and gid < 2000")
def scan_gid_range(spark, sf_dir):
    return reads.scan(_by_user(spark, sf_dir), 1000, 2000).select("gid", "shard_id", "stream", "seq")


@query(U + "select gid, shard_id, stream, seq from u where shard_id = 2 and gid >= 100")
def scan_shard(spark, sf_dir):
    return reads.scan_shard(_by_user(spark, sf_dir), 2, 100).select("gid", "shard_id", "stream", "seq")


@query(U + "select seq, event_type, shard_id from u where stream = 'user-7' and seq >= 5 and shard_id in (1, 3) order by seq limit 20")
def scan_stream_filtered(spark, sf_dir):
    return reads.scan_stream(_by_user(spark, sf_dir), "fixture", "user-7", 5, [1, 3], 20).select("seq", "event_type", "shard_id")


@query(U + """, a as (select unnest([5, 1000000000, 0, 5, 17]) as asked, unnest([0, 1, 2, 3, 4]) as pos)
select pos::bigint as pos, asked::bigint as asked, stream, seq, seq is not null as found from a left join u on gid = asked""")
def multi_get_ordered(spark, sf_dir):
    return reads.multi_get(_by_user(spark, sf_dir), [5, 1000000000, 0, 5, 17]).select("pos", "asked", "stream", "seq", "found")


@query(U + "select gid, stream, seq, event_type from u where gid = 42")
def point_read_gid(spark, sf_dir):
    return reads.read_gid(_by_user(spark, sf_dir), 42).select("gid", "stream", "seq", "event_type")


@query(U + _CUT + "select seq, event_type from u left join cut using (user_id) where stream in ('user-7') and seq = 3 and seq > coalesce(cutoff, 0)")
def point_read(spark, sf_dir):
    return reads.read_seq(live.live(_tombstoned(spark, sf_dir)), "fixture", "user-7", 3).select("seq", "event_type")


@query(U + "select gid, shard_id from u where gid >= 3000")
def replay_from(spark, sf_dir):
    return reads.replay_from(_by_user(spark, sf_dir), 3000).select("gid", "shard_id")


def _positions(spark: SparkSession, start: int) -> DataFrame:
    return spark.range(SHARDS).select(F.col("id").cast("int").alias("shard_id"), (F.col("id") * 3 + start).alias("position"))


_TAILED = U + ", b as (select * from u where local >= shard_id * 3 + 10 order by gid limit 50) "


@query(_TAILED + "select gid, shard_id, seq from b")
def tailer_batch(spark, sf_dir):
    return reads.tailer_batch(_by_user(spark, sf_dir), _positions(spark, 10), SHARDS, 50)[0].select("gid", "shard_id", "seq")


@query(_TAILED + "select s as shard_id, coalesce(max(local) + 1, s * 3 + 10)::bigint as position from (select unnest([0, 1, 2, 3])::integer as s) left join b on shard_id = s group by s")
def tailer_positions(spark, sf_dir):
    return reads.tailer_batch(_by_user(spark, sf_dir), _positions(spark, 10), SHARDS, 50)[1]


# --- ids, appends, quotas


@query(U + "select gid, local, shard_id, local * 4 + shard_id as again from u")
def gid_encode_decode(spark, sf_dir):
    local, shard = gid_local(F.col("gid"), SHARDS), gid_shard(F.col("gid"), SHARDS)
    return _by_user(spark, sf_dir).select("gid", local.alias("local"), shard.alias("shard_id"), encode_gid(local, shard, SHARDS).alias("again"))


@query(U + "select shard_id, count(*) as n, min(gid) as first_gid, max(gid) as last_gid from u group by shard_id")
def shard_distribution(spark, sf_dir):
    return _by_user(spark, sf_dir).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.min("gid").alias("first_gid"), F.max("gid").alias("last_gid"))


#: CRC-32C of an ASCII text in SQL: the table of its 256 remainders, and a fold over the text's bytes.
_CRC_TABLE = """with crc as (select list(list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 2197175160) else c >> 1 end) order by i) as t
 from (select unnest(range(256)) as i)) """
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


@query(_CRC_TABLE + f"select stream, ({_CRC.format('stream')} % 4)::integer as shard_id, n from (select 'user-' || user_id::varchar as stream, count(*) as n from events group by 1), crc")
def route_by_crc32c(spark, sf_dir):
    return writer.route(_by_user(spark, sf_dir), SHARDS, "stream").groupBy("stream").agg(F.min("shard_id").alias("shard_id"), F.count(F.lit(1)).alias("n"))


@query(U + "select stream, event_id, seq from u where event_id >= (select count(*) // 2 from events)")
def append_assign_seq(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    half = events.count() // 2
    new = events.where(F.col("event_id") >= half).select(
        F.lit("fixture").alias("namespace"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream"), "event_id"
    )
    there = adapters.events_by_user(events.where(F.col("event_id") < half))
    return writer.assign_seq(new, there, "event_id").select("stream", "event_id", "seq")


@query(R + "select event_type, seq from r")
def append_single_stream(spark, sf_dir):
    return writer.assign_seq_single(_table(spark, sf_dir, "events"), 0, "event_id").select("event_type", "seq")


def _arriving(events: DataFrame) -> DataFrame:
    """Events as they come to be appended: a stream for each user, event_id as the arrival, without a timestamp."""
    return events.select(
        F.lit("fixture").alias("namespace"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream"), "event_type",
        F.lit(None).cast("string").alias("content_type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("props").cast("binary").alias("content"),
        F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("metadata"), F.col("event_id").alias("arrival"),
    ).withColumn("timestamp_ns", F.col("micros") * 1000).drop("micros")


@query(_CRC_TABLE + f""", s as (select *, ({_CRC.format('stream')} % 4)::integer as shard_id from (select distinct 'user-' || user_id::varchar as stream, user_id from events), crc),
e as (select stream, event_id, event_type, props, shard_id, event_id >= (select count(*) // 2 from events) as late from events join s using (user_id)),
n as (select *, row_number() over (partition by stream order by event_id) as seq, row_number() over (partition by shard_id order by event_id) - 1 as local from e)
select stream, seq, local * 4 + shard_id as gid, shard_id, event_type, 'application/json' as content_type, props as content from n""")
def append_end_to_end(spark, sf_dir):
    """Half of the events is appended and written, then the other half to what the table has; the table is read back."""
    events = _table(spark, sf_dir, "events")
    half, at = events.count() // 2, store.new_path(spark, "appended")
    writer.write(writer.append(_arriving(events.where(F.col("event_id") < half)), store.open_table(spark, at), SHARDS, "stream"), at)
    writer.write(writer.append(_arriving(events.where(F.col("event_id") >= half)), store.open_table(spark, at), SHARDS, "stream"), at)
    return store.open_table(spark, at).select("stream", "seq", "gid", "shard_id", "event_type", "content_type", F.col("content").cast("string").alias("content"))


_BAD = "case when event_id % 11 = 0 then 'namespace' when event_id % 13 = 0 then 'stream' when event_id % 17 = 0 then 'metadata' when event_id % 19 = 0 then 'content' when event_id % 23 = 0 then 'event_type' when event_id % 29 = 0 then 'metadata_key' else 'none' end"


@query(f"select {_BAD} as rejected, count(*) as n from events group by 1")
def append_validation(spark, sf_dir):
    e = F.col("seq") - 1
    bad = lambda n, c, v: F.when(e % n == 0, v).otherwise(F.col(c))
    large = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: F.concat(F.lit("k"), i.cast("string"))), F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: F.lit("v")))
    rows = _events(spark, sf_dir).withColumns(
        {
            "namespace": bad(11, "namespace", F.lit("_hidden")),
            "stream": bad(13, "stream", F.lit("a//b")),
            "metadata": F.when(e % 17 == 0, large).when(e % 29 == 0, F.create_map(F.lit("No"), F.lit("v"))).otherwise(F.col("metadata")),
            "content": bad(19, "content", F.repeat(F.lit("x"), 200).cast("binary")),
            "event_type": bad(23, "event_type", F.lit("Not ok")),
        }
    )
    return rows.select(F.coalesce(rejection(content_bytes=100), F.lit("none")).alias("rejected")).groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))


_USAGE = U + _CUT + ", q as (select 'fixture' as namespace, stream, count(*) as n_records, sum(strlen(props))::bigint as n_bytes from u left join cut using (user_id) where seq > coalesce(cutoff, 0) group by stream) "


@query(_USAGE + "select * from q")
def quota_usage(spark, sf_dir):
    return retention.quota_usage(_tombstoned(spark, sf_dir))


@query(_USAGE + "select s.stream, coalesce(n_records, 0) + 10 <= 60 and coalesce(n_bytes, 0) + 100 <= 650 as accepted from (select distinct stream from u) s left join q using (stream)")
def quota_reject(spark, sf_dir):
    records = _tombstoned(spark, sf_dir)
    names = records.select("namespace", "stream").distinct()
    batch = names.select("*", F.lit(10).alias("add_records"), F.lit(100).alias("add_bytes"))
    quotas = names.select("*", F.lit(60).alias("max_records"), F.lit(650).alias("max_bytes"))
    return retention.quota_check(retention.quota_usage(records), batch, quotas).select("stream", "accepted")


# --- catalog


@query("select ns as namespace, count(distinct user_id) as n_streams from (select user_id, case when user_id % 5 = 0 then '_meta' else 'ns' || (user_id % 3)::varchar end as ns from events) where ns not like '\\_%' escape '\\' group by ns")
def list_namespaces(spark, sf_dir):
    user = F.col("stream_id") - 1
    ns = F.when(user % 5 == 0, F.lit("_meta")).otherwise(F.concat(F.lit("ns"), (user % 3).cast("string")))
    return catalog.list_namespaces(_by_user(spark, sf_dir).withColumn("namespace", ns))


@query(U + "select 'fixture' as namespace, stream, min(seq) as first_seq, max(seq) as last_seq, count(*) as n_records from u group by stream")
def list_streams(spark, sf_dir):
    return catalog.list_streams(_by_user(spark, sf_dir))


@query(U + "select 'fixture' as namespace, stream, max(seq) + 1 as next_seq from u group by stream")
def next_seq(spark, sf_dir):
    return catalog.next_seq(_by_user(spark, sf_dir))


@query(U + "select s.stream, user_id + 1 as stream_id from (select unnest(['user-1', 'user-2', 'user-none']) as stream) s left join (select distinct stream, user_id from u) using (stream)")
def resolve_names(spark, sf_dir):
    asked = spark.createDataFrame([("fixture", s) for s in ("user-1", "user-2", "user-none")], "namespace string, stream string")
    return catalog.resolve(asked, catalog.name_ids(_by_user(spark, sf_dir))).select("stream", "stream_id")


@query(U + "select shard_id, max(local) + 1 as cursor from u group by shard_id")
def shard_cursors(spark, sf_dir):
    return catalog.shard_cursors(_by_user(spark, sf_dir), SHARDS)


@query(U + "select min(seq) as oldest_seq, max(seq) as newest_seq, (select min(c) from (select max(local) + 1 as c from u group by shard_id)) as min_cursor, (select max(c) from (select max(local) + 1 as c from u group by shard_id)) as max_cursor from u")
def watermark(spark, sf_dir):
    return catalog.watermark(_by_user(spark, sf_dir), SHARDS)


@query(U + "select 1001::bigint as from_sequence, (select min(c * 4 + s) from (select max(local) + 1 as c, shard_id as s from u group by shard_id)) as to_sequence, count(*) as n_records from u where gid >= 1001")
def recovery_report(spark, sf_dir):
    return catalog.recovery_report(_by_user(spark, sf_dir), SHARDS, 1001)


@query("""with o as (select event_id as seq, 'key' || (user_id % 50)::varchar as key, case when event_type = 'error' then 'DEL' else 'PUT' end as op, value::decimal(18,2)::varchar as v from events),
l as (select key, arg_max(op, seq) as op, arg_max(v, seq) as v from o group by key) select key, v as value from l where op = 'PUT'""")
def kv_replay(spark, sf_dir):
    key = F.concat(F.lit("key"), (F.col("user_id") % 50).cast("string"))
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("DEL "), key)).otherwise(F.concat(F.lit("PUT "), key, F.lit(" "), F.col("value").cast("decimal(18,2)").cast("string")))
    return catalog.kv_replay(_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), text.alias("text")))


# --- integrity

_CHECK = """ from (select s, n, min(n) over (partition by s) + row_number() over (partition by s order by n) - 1 as e from ({0})) group by s"""
_CHECKED = "select '{1}' || s::varchar as stream, count(*) filter (n <> e) = 0 as ok, min(n)::bigint as verified_from, max(n)::bigint as verified_to, coalesce(min(e) filter (n <> e), 0)::bigint as error_at_seq, count(*) as n_records" + _CHECK
_TURNS, _LINES = "select conv_id as s, turn + 1 as n from conversations", "select l_orderkey as s, l_linenumber as n from lineitem"


@query(_CHECKED.format(_TURNS, "conv-"))
def verify_chain_ok(spark, sf_dir):
    return integrity.verify_chain(_conversations(spark, sf_dir)).drop("namespace")


@query("select count(*) filter (not ok) as n_bad, count(*) as n_streams from (" + _CHECKED.format(_LINES, "order-") + ")")
def verify_chain_gaps(spark, sf_dir):
    checked = integrity.verify_chain(adapters.lineitem_log(_table(spark, sf_dir, "lineitem")))
    return checked.agg(F.count(F.when(~F.col("ok"), 1)).alias("n_bad"), F.count(F.lit(1)).alias("n_streams"))


@query("select * from (" + _CHECKED.format(_LINES, "order-") + ") where not ok")
def verify_chain_first_error(spark, sf_dir):
    return integrity.verify_chain(adapters.lineitem_log(_table(spark, sf_dir, "lineitem"))).where("NOT ok").drop("namespace")


_CHAIN = """with recursive t as (select conv_id, turn + 1 as seq, encode(text) as content from conversations),
c as (select conv_id, seq, sha256(unhex(repeat('00', 32)) || content) as h from t where seq = 1
 union all select t.conv_id, t.seq, sha256(unhex(c.h) || t.content) from c join t on t.conv_id = c.conv_id and t.seq = c.seq + 1) """


@query(_CHAIN + "select 'conv-' || conv_id::varchar as stream, seq, h as hash from c")
def hash_chain_build(spark, sf_dir):
    built = integrity.build_hashes(_conversations(spark, sf_dir), ["stream"], "seq")
    return built.select("stream", "seq", F.lower(F.hex("hash_n")).alias("hash"))


@query("select 'conv-' || conv_id::varchar as stream, true as ok, null::bigint as first_broken, count(*) as n_records from conversations group by conv_id")
def hash_chain_verify(spark, sf_dir):
    return integrity.broken_links(integrity.build_hashes(_conversations(spark, sf_dir), ["stream"], "seq"), ["stream"], "seq")


@query("select 'conv-' || conv_id::varchar as stream, count(*) filter (bad) = 0 as ok, min(turn + 1) filter (bad) as first_broken, count(*) as n_records from (select *, conv_id % 10 = 3 and turn = 1 as bad from conversations) group by conv_id")
def hash_chain_tamper(spark, sf_dir):
    built = integrity.build_hashes(_conversations(spark, sf_dir), ["stream"], "seq")
    bad = ((F.col("stream_id") - 1) % 10 == 3) & (F.col("seq") == 2)
    changed = built.withColumn("content", F.when(bad, F.concat("content", F.lit(b"x"))).otherwise(F.col("content")))
    return integrity.broken_links(changed, ["stream"], "seq")


#: The key of the keyed chain's queries: bytes 0 to 31.
_CHAIN_KEY = bytes(range(32))


@query("select 'conv-' || conv_id::varchar as stream, count(*) filter (bad) = 0 as ok, min(turn + 1) filter (bad) as first_broken, count(*) as n_records from (select *, conv_id % 10 = 3 and turn = 1 as bad from conversations) group by conv_id")
def keyed_hash_chain_tamper(spark, sf_dir):
    built = integrity.build_hashes(_conversations(spark, sf_dir), ["stream"], "seq", _CHAIN_KEY)
    bad = ((F.col("stream_id") - 1) % 10 == 3) & (F.col("seq") == 2)
    changed = built.withColumn("content", F.when(bad, F.concat("content", F.lit(b"x"))).otherwise(F.col("content")))
    return integrity.broken_links(changed, ["stream"], "seq", _CHAIN_KEY)


# --- consumers


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).alias("group"), F.pmod("event_id", F.lit(4)).alias("shard"), (F.col("event_id") * 7919 % 10007).alias("committed"), F.col("event_id").alias("commit_no")
    )


_COMMITS = 'with c as (select user_id % 7 as "group", event_id % 4 as shard, event_id * 7919 % 10007 as committed, event_id as commit_no from events) '


@query(_COMMITS + 'select "group", shard, arg_max(committed, commit_no) as committed from c group by all')
def offset_latest(spark, sf_dir):
    return consumers.latest_offsets(_commits(spark, sf_dir), ["group", "shard"])


@query(_COMMITS + 'select "group", shard, max(committed) as committed from c group by all')
def offset_monotonic(spark, sf_dir):
    return consumers.shard_offsets(_commits(spark, sf_dir), ["group", "shard"])


_FOLD = """with c as (select event_id as no, user_id % 7 as g, event_id % 4 as shard, event_id * 7919 % 10007 as seq from events),
s as (select 600 as no, g, s.shard, 5000 + s.shard as seq from (select unnest([0, 1, 2]) as g), (select unnest([0, 1]) as shard) s),
f as (select g, shard, seq from s union all select g, shard, seq from c where no > 600) """


@query(_FOLD + """select 'n' as namespace, 's' as stream, 'g' || g::varchar as "group", shard::bigint as shard, max(seq)::bigint as seq from f group by g, shard""")
def offset_fold(spark, sf_dir):
    o = lambda g, shard, seq: F.struct(F.lit("n").alias("ns"), F.lit("s").alias("stream"), F.concat(F.lit("g"), g.cast("string")).alias("group"), shard.alias("shard"), seq.alias("seq"))
    commits = _commits(spark, sf_dir).select(
        F.col("commit_no").alias("seq"), F.lit(consumers.COMMITTED).alias("event_type"), F.to_json(o(F.col("group"), F.col("shard"), F.col("committed"))).alias("content")
    )
    snapshot = F.array(*[o(F.lit(g), F.lit(s), F.lit(5000 + s)) for g in range(3) for s in range(2)])
    marks = spark.range(1).select(F.lit(600).cast("long").alias("seq"), F.lit(consumers.SNAPSHOT).alias("event_type"), F.to_json(snapshot).alias("content"))
    return consumers.fold_offsets(commits.where("seq <> 600").unionByName(marks))


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.concat(F.lit("g"), F.col("group").cast("string"))
    return _commits(spark, sf_dir).select(F.lit("n").alias("namespace"), F.lit("s").alias("stream"), g.alias("group"), "shard", F.col("committed").alias("seq"), "commit_no")


_GROUPS = _COMMITS + """select 'n' as namespace, 's' as stream, 'g' || "group"::varchar as "group", shard::bigint as shard, max(committed)::bigint as seq from c {0} group by all"""


@query(_GROUPS.format('where "group" = 3'))
def offset_group_listing(spark, sf_dir):
    """One group's offsets, read back from a table that was committed to twice."""
    offsets, at = _offsets(spark, sf_dir), store.new_path(spark, "offsets")
    for late in (False, True):
        consumers.commit_offsets(offsets.where((F.col("commit_no") % 2 == 1) == late), at)
    return consumers.group_offsets(spark, at, "g3")


@query(_GROUPS.format(""))
def offset_snapshot_roundtrip(spark, sf_dir):
    """Offsets as a snapshot event, folded back."""
    event = consumers.snapshot_event(consumers.shard_offsets(_offsets(spark, sf_dir).withColumnRenamed("seq", "committed"), consumers.OFFSET_KEY).withColumnRenamed("committed", "seq"))
    return consumers.fold_offsets(event.withColumn("seq", F.lit(1).cast("long")))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("g"), (F.col("o_custkey") % 20).cast("string")).alias("group"),
        F.concat(F.lit("b"), (F.col("o_orderkey") % 5).cast("string")).alias("broker_id"),
        (F.col("o_orderkey") * 31 % 17).alias("epoch"),
        F.col("o_orderkey").alias("timestamp_ms"),
    )


@query("""with c as (select 'g' || (o_custkey % 20)::varchar as "group", 'b' || (o_orderkey % 5)::varchar as broker_id, o_orderkey * 31 % 17 as epoch, o_orderkey as timestamp_ms from orders)
select "group", broker_id, epoch, timestamp_ms, greatest(0, 1490 - timestamp_ms) <= 50 as fresh from (select *, row_number() over (partition by "group" order by epoch desc, timestamp_ms desc, broker_id desc) as k from c) where k = 1""")
def leader_pick(spark, sf_dir):
    return consumers.pick_leaders(_claims(spark, sf_dir), now_ms=1490, lease_ms=50)


@query("""with m as (select o_custkey % 20 as "group", o_custkey as member, min(o_orderkey) as joined from orders group by all),
r as (select *, row_number() over (partition by "group" order by joined, member) - 1 as rank, count(*) over (partition by "group") as n from m)
select r."group", shard, member from r, (select unnest(range(16)) as shard) where rank = shard % n""")
def assign_round_robin(spark, sf_dir):
    """All customers as members: groups of more members than shards, too."""
    orders = _table(spark, sf_dir, "orders")
    members = orders.groupBy((F.col("o_custkey") % 20).alias("group"), F.col("o_custkey").alias("member")).agg(F.min("o_orderkey").alias("joined"))
    shards = members.select("group").distinct().select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("shard"))
    return consumers.assign_round_robin(shards, members)


def _assignment(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("g", s, f"m{s % 2}") for s in (0, 1, 3)], "group string, shard long, member string")


@query(U + """select 'g' as "group", 'm' || (shard_id % 2)::varchar as member, shard_id, stream, seq from u where shard_id in (0, 1, 3) and seq > case shard_id when 0 then 20 when 1 then 30 else 0 end""")
def consume_resume(spark, sf_dir):
    offsets = spark.createDataFrame([("g", 0, 20), ("g", 1, 30)], "group string, shard long, seq long")
    return consumers.consume(_by_user(spark, sf_dir), _assignment(spark), offsets).select("group", "member", "shard_id", "stream", "seq")


@query(U + """select 'g' as "group", 'm' || (shard_id % 2)::varchar as member, shard_id, max(seq) as last_seq from u where shard_id in (0, 1, 3) group by shard_id""")
def consume_caught_up(spark, sf_dir):
    return consumers.caught_up(_by_user(spark, sf_dir), _assignment(spark))


@query('select user_id % 7 as "group", user_id as member from events group by all having (select count(*) from events) - max(event_id) > 200')
def stale_members(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    beats = events.select((F.col("user_id") % 7).alias("group"), F.col("user_id").alias("member"), F.col("event_id").alias("heartbeat_ms"))
    return consumers.stale_members(beats, events.count(), 200)


# --- retention

_SEGMENTS = U + ", g as (select shard_id, local // 100 + 1 as segment_id, min(gid) as base_seq, sum(strlen(props))::bigint as bytes, max(timestamp_ns) as modified_ns from u group by all) "


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.segments_of(_by_user(spark, sf_dir).withColumn("local_seq", gid_local(F.col("gid"), SHARDS)), 100)


@query(_SEGMENTS + "select shard_id, segment_id from (select *, sum(bytes) over (partition by shard_id order by segment_id desc) as rest, max(segment_id) over (partition by shard_id) as top from g) where rest > 2000 and segment_id < top")
def retention_max_bytes(spark, sf_dir):
    return retention.retain_max_bytes(_segments(spark, sf_dir), 2000)


@query(_SEGMENTS + "select shard_id, segment_id from (select *, max(segment_id) over (partition by shard_id) as top, max(modified_ns) over () as now from g) where segment_id < top and now - modified_ns >= 86400000000000")
def retention_max_age(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    now = segments.agg(F.max("modified_ns")).first()[0] or 0
    return retention.retain_max_age(segments, now, 86_400_000_000_000)


@query(_SEGMENTS + "select shard_id, segment_id from (select *, lead(base_seq) over (partition by shard_id order by segment_id) as nxt from g) where nxt <= 900")
def checkpoint_truncate(spark, sf_dir):
    return retention.truncate_before(_segments(spark, sf_dir), 900)


@query(_SEGMENTS + "select shard_id, count(*) as n_segments, sum(bytes)::bigint as n_bytes from g group by shard_id")
def wal_usage(spark, sf_dir):
    return retention.wal_usage(_segments(spark, sf_dir))


# --- exports, encryption, streams


@query(R + """select '{"namespace":"fixture","stream":"events","seq":' || seq::varchar || ',"event_type":"' || event_type || '","content_type":"application/json","timestamp_ns":' || timestamp_ns::varchar || ',"content":"' || to_base64(props::blob) || '"}' as line from r""")
def export_json_lines(spark, sf_dir):
    return export.json_lines(_events(spark, sf_dir))


@query(U + "select gid, stream, seq from u")
def replicate_resume(spark, sf_dir):
    """A standby gets half of the records, then all of them: what it has is passed over."""
    records, at = _by_user(spark, sf_dir), store.new_path(spark, "standby")
    copy = export.replicate(at, 1, lambda: 1)
    copy(records.where("gid % 2 = 0"), 0)
    copy(records, 1)
    return spark.read.parquet(at).select("gid", "stream", "seq")


@query(U + "select 'fixture' as namespace, stream, true as ok, 1::bigint as verified_from, max(seq) as verified_to, 0::bigint as error_at_seq, count(*) as n_records from u group by stream")
def backup_restore(spark, sf_dir):
    """The restored table's sequence check."""
    at = store.new_path(spark, "backup")
    backup.backup(spark, _record_table(spark, sf_dir, "by_user", adapters.events_by_user), f"{at}/kept")
    return backup.restore(spark, f"{at}/kept", f"{at}/restored")


@query(R + """select '{"namespace":"fixture","stream":"events","seq":' || seq::varchar || ',"event_type":"' || event_type || '","content_type":"application/json","timestamp_ns":' || timestamp_ns::varchar || ',"content":"' || to_base64(props::blob) || '"}' as line from r""")
def export_resume(spark, sf_dir):
    """An export that stops after a part of the table and goes on from its checkpoint when the rest has come."""
    at, records = store.new_path(spark, "export"), _events(spark, sf_dir)
    for part in (records.where("seq % 3 = 0"), records.where("seq % 3 <> 0")):
        writer.write(part, f"{at}/table")
        rows = tail.open_stream(spark, f"{at}/table")
        tail.drain(rows.select(export.json_line().alias("line")), f"{at}/lines", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/lines")


@query(R + "select seq, case when seq % 3 <> 2 then props end as content from r")
def aes_keyring_roundtrip(spark, sf_dir):
    keys = [bytes([k]) * 32 for k in (1, 2, 3)]
    sealed = F.when(F.col("seq") % 3 == 0, encrypt(F.col("content"), keys[0])).when(F.col("seq") % 3 == 1, encrypt(F.col("content"), keys[1])).otherwise(encrypt(F.col("content"), keys[2]))
    return _events(spark, sf_dir).select("seq", decrypt_with_ring(sealed, keys[:2]).cast("string").alias("content"))


def _streamed(spark: SparkSession, table: str, select: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the record table, read in several batches, delivers."""
    at = store.new_path(spark, "stream")
    tail.drain(select(tail.open_stream(spark, table, 1)), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query(R + _SHOWN + "where seq >= 301")
def tail_available_now(spark, sf_dir):
    table = _record_table(spark, sf_dir, "events", adapters.events_log)
    return _streamed(spark, table, lambda s: _shown(tail.tail(s, "fixture", "events", committed=300)))


@query(R + _SHOWN + "where event_type in ('purchase', 'signup') and seq > 500")
def subscribe_resume(spark, sf_dir):
    table = _record_table(spark, sf_dir, "events", adapters.events_log)
    return _streamed(spark, table, lambda s: _shown(tail.subscribe(s, ["purchase", "signup"], 500)))

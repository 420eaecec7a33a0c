"""Consumer groups: offsets, assignment, leadership."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import exists

OFFSET_KEY = ["namespace", "stream", "group", "shard"]
_OFFSET = T.StructType(
    [
        T.StructField("ns", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("shard", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
SNAPSHOT, COMMITTED = "offset_snapshot", "offset_committed"


def latest_offsets(commits: DataFrame, by: list[str]) -> DataFrame:
    """A single consumer's offsets: the last commit wins, even one that goes back.  ``commits``: by + (committed, commit_no)."""
    return commits.groupBy(*by).agg(F.max_by("committed", "commit_no").alias("committed"))


def shard_offsets(commits: DataFrame, by: list[str]) -> DataFrame:
    """A group's offsets: the largest commit wins.  ``commits``: by + (committed)."""
    return commits.groupBy(*by).agg(F.max("committed").alias("committed"))


def commit_offsets(offsets: DataFrame, path: str) -> None:
    """Append offsets (namespace, stream, group, shard, seq) to the table at ``path``: a commit is one job, done or not done."""
    offsets.select(*OFFSET_KEY, "seq").write.mode("append").parquet(path)


def group_offsets(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """The offsets that commit_offsets wrote, the largest of each key; of one group if it is named.  No table, no offsets."""
    schema = "namespace string, stream string, `group` string, shard long, seq long"
    rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    rows = rows if group is None else rows.where(F.col("group") == group)
    return rows.groupBy(*OFFSET_KEY).agg(F.max("seq").alias("seq"))


def fold_offsets(events: DataFrame) -> DataFrame:
    """(namespace, stream, group, shard, seq) from a log of JSON events (seq, event_type, content as text).

    A snapshot replaces all before it; commits after it raise single offsets.
    Content that is no JSON of its kind is passed over.
    """
    parsed = events.where(F.col("event_type").isin(SNAPSHOT, COMMITTED)).select(
        F.col("seq").alias("at"),
        F.when(F.col("event_type") == SNAPSHOT, F.from_json("content", T.ArrayType(_OFFSET))).alias("all"),
        F.when(F.col("event_type") == COMMITTED, F.from_json("content", _OFFSET)).alias("one"),
    )
    last = parsed.where("all IS NOT NULL").agg(F.coalesce(F.max("at"), F.lit(-1)).alias("base"))
    rows = parsed.withColumn("k", F.lit(1)).join(F.broadcast(last.withColumn("k", F.lit(1))), "k").where("at >= base")  # one row
    entries = rows.select(F.explode(F.coalesce("all", F.when(F.col("one.ns").isNotNull(), F.array("one")))).alias("o"))
    return entries.groupBy(F.col("o.ns").alias("namespace"), F.col("o.stream").alias("stream"), F.col("o.group").alias("group"), F.col("o.shard").alias("shard")).agg(F.max("o.seq").alias("seq"))


def snapshot_event(offsets: DataFrame) -> DataFrame:
    """One row, (event_type, content): the offsets as a snapshot event to append.  Offsets are one number for each group and shard."""
    o = F.struct(F.col("namespace").alias("ns"), "stream", "group", "shard", "seq")
    return offsets.agg(F.lit(SNAPSHOT).alias("event_type"), F.to_json(F.array_sort(F.collect_list(o))).alias("content"))


def assign_round_robin(shards: DataFrame, members: DataFrame) -> DataFrame:
    """(group, shard, member): shard i goes to member i mod n, members in their order of joining.

    ``shards``: (group, shard); ``members``: (group, member, joined).
    """
    w = Window.partitionBy("group")
    ranked = members.select("group", "member", (F.row_number().over(w.orderBy("joined", "member")) - 1).alias("rank"), F.count(F.lit(1)).over(w).alias("n"))
    counts = ranked.select("group", "n").distinct()
    return shards.join(counts, "group").withColumn("rank", F.pmod(F.col("shard"), F.col("n"))).join(ranked.drop("n"), ["group", "rank"]).select("group", "shard", "member")


def pick_leaders(claims: DataFrame, now_ms: int, lease_ms: int) -> DataFrame:
    """For each group the claim of the highest epoch, then time: broker_id, epoch, timestamp_ms, and fresh (within the lease)."""
    top = claims.groupBy("group").agg(F.max_by(F.struct("broker_id", "epoch", "timestamp_ms"), F.struct("epoch", "timestamp_ms", "broker_id")).alias("c"))
    age = F.greatest(F.lit(0), F.lit(now_ms) - F.col("c.timestamp_ms"))
    return top.select("group", "c.broker_id", "c.epoch", "c.timestamp_ms", (age <= lease_ms).alias("fresh"))


def leader_decision(leader: dict | None, broker_id: str) -> tuple[str, int]:
    """What a broker does about a group: ('leader' | 'standby' | 'claim', epoch).  A stale leadership is claimed with the next epoch."""
    if leader is None:
        return "claim", 1
    if not leader["fresh"]:
        return "claim", leader["epoch"] + 1
    return ("leader" if leader["broker_id"] == broker_id else "standby"), leader["epoch"]


def stale_members(heartbeats: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """(group, member) whose last heartbeat is older than the timeout."""
    return heartbeats.groupBy("group", "member").agg(F.max("heartbeat_ms").alias("last")).where(F.lit(now_ms) - F.col("last") > timeout_ms).select("group", "member")


def consume(records: DataFrame, assignment: DataFrame, offsets: DataFrame) -> DataFrame:
    """Records of each member's shards after the group's offset, with group, member.

    ``assignment``: (group, shard, member); ``offsets``: (group, shard, seq).
    A group's shards are few, but the join is left to their size.
    """
    due = assignment.join(offsets, ["group", "shard"], "left").select("group", "member", F.col("shard").cast("int").alias("shard_id"), F.coalesce("seq", F.lit(0)).alias("after"))
    return records.join(due, "shard_id").where(F.col("seq") > F.col("after")).drop("after")


def caught_up(records: DataFrame, assignment: DataFrame) -> DataFrame:
    """(group, member, shard_id, last_seq): for each assigned shard what it is caught up to, 0 where it is empty."""
    last = records.groupBy("shard_id").agg(F.max("seq").alias("last_seq"))
    return assignment.select("group", "member", F.col("shard").cast("int").alias("shard_id")).join(last, "shard_id", "left").select("group", "member", "shard_id", F.coalesce("last_seq", F.lit(0)).alias("last_seq"))


@dataclass
class Group:
    """Membership of one group and its sticky assignment: a state machine of the driver, on names and shard numbers alone."""

    shards: int
    members: list[str] = field(default_factory=list)
    assigned: dict[str, list[int]] = field(default_factory=dict)
    generation: int = 0
    changed: set[str] = field(default_factory=set)

    def join(self, member: str) -> list[int]:
        """A new member rebalances and begins a generation; one that is back changes nothing."""
        if member not in self.members:
            self.members.append(member)
            self._rebalance()
        return self.assigned[member]

    def leave(self, member: str) -> bool:
        if member not in self.members:
            return False
        self.members.remove(member)
        self._rebalance()
        return True

    def quotas(self) -> dict[str, int]:
        """Shards of each member: as even as can be, earlier members have the extra ones."""
        least, extra = divmod(self.shards, len(self.members)) if self.members else (0, 0)
        return {m: least + (i < extra) for i, m in enumerate(self.members)}

    def _rebalance(self) -> None:
        self.generation += 1
        before = {m: list(s) for m, s in self.assigned.items()}
        n, quotas = len(self.members), self.quotas()
        rank = {m: i for i, m in enumerate(self.members)}

        def preference(member: str):
            # A member over its quota gives up first what round robin would give another, then its highest.
            return lambda s: (s % n != rank[member], s)

        keep = {m: sorted(before.get(m, []), key=preference(m))[: quotas[m]] for m in self.members}
        held = {s for shards in keep.values() for s in shards}
        free = [s for s in range(self.shards) if s not in held]
        # First to whom round robin would give them, then to whoever has room.
        for s in list(free):
            home = self.members[s % n] if n else None
            if home is not None and len(keep[home]) < quotas[home]:
                keep[home].append(s)
                free.remove(s)
        for m in self.members:
            while len(keep[m]) < quotas[m]:
                keep[m].append(free.pop(0))
        self.assigned = {m: sorted(s) for m, s in keep.items()}
        self.changed = {m for m in {*before, *self.assigned} if before.get(m) != self.assigned.get(m)}

"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns its documents into shards of word ids, sorts the shard's
suffixes (a suffix array, ordered as deep as a window is long) and
binary-searches every test suffix in it; runs of found suffixes on one diagonal
are the longest verbatim matches.  Documents never move: the test side is what
is sent, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD_WORDS, arrow_apply, new_path, ref, struct_array, text_bytes

#: Words of a window, of a shard (a longer document is a shard of its own), bytes of test text sent at once.
WINDOW, SHARD_WORDS, BLOCK_BYTES = 10, 1_000_000, 8 << 20

MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.StringType()),
            T.StructField("item_start", T.IntegerType()),
            T.StructField("doc_start", T.IntegerType()),
            T.StructField("n_words", T.IntegerType()),
        ]
    )
)
_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())])
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_FIELDS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(_SPAN)), ("matches", pa.list_(_MATCH))]
_SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
        T.StructField("matches", MATCHES),
    ]
)


def words(text: bytes) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(FOLD_WORDS).split()


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): for each i the values first[i] .. first[i] + count[i] - 1."""
    which = np.repeat(np.arange(len(count)), count)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


class TestIndex:
    """The test suffixes of a block of items, each cut to its window."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.item_ids = window, [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        rows, owner, start, length = [], [], [], []
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if not len(ids):
                continue
            n = min(window, len(ids))
            m = np.zeros((len(ids) - n + 1, window), np.int32)
            m[:, :n] = np.lib.stride_tricks.sliding_window_view(ids, n)
            rows.append(m)
            owner += [k] * len(m)
            start += range(len(m))
            length += [n] * len(m)
        every = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
        self.queries, same = np.unique(every, axis=0, return_inverse=True)
        same = same.reshape(-1)
        self.length = np.zeros(len(self.queries), np.int64)
        self.length[same] = length
        order = np.argsort(same, kind="stable")
        self.owner, self.start = np.array(owner, np.int64)[order], np.array(start, np.int64)[order]
        self.owners = np.bincount(same, minlength=len(self.queries))
        self.first_owner = np.cumsum(self.owners) - self.owners
        size = len(self.vocabulary) + 1
        self.size = size
        self.single = np.zeros(size, bool)
        self.single[self.queries[self.length == 1, 0]] = True
        self.opens = np.zeros(size, bool)
        self.opens[self.queries[:, 0]] = True
        q = self.queries.astype(np.int64)
        self.pairs = np.unique((q[:, 0] * size + q[:, 1])[self.length > 1])

    def suffixes(self, shard: np.ndarray) -> np.ndarray:
        """The suffix array of the shard, of the suffixes that begin as a test suffix does; ``shard`` ends with ``window`` zeros."""
        body = shard[: len(shard) - self.window]
        at = np.flatnonzero(self.opens[body])
        if not len(at):
            return at
        pair = body[at].astype(np.int64) * self.size + shard[at + 1]
        found = np.searchsorted(self.pairs, pair)
        hit = self.single[body[at]]
        inside = found < len(self.pairs)
        hit[inside] |= self.pairs[found[inside]] == pair[inside]
        at = at[hit]
        columns = shard[at[:, None] + np.arange(self.window)]
        return at[np.lexsort(columns.T[::-1])]

    def search(self, shard: np.ndarray, suffixes: np.ndarray, after: bool) -> np.ndarray:
        """For every test suffix the first place in the suffix array whose words are not less (``after``: are greater)."""
        lo, hi = np.zeros(len(self.queries), np.int64), np.full(len(self.queries), len(suffixes), np.int64)
        steps, ahead = np.arange(self.window), np.arange(self.window) >= self.length[:, None]
        open_ = np.arange(len(self.queries))
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            diff = shard[suffixes[mid][:, None] + steps] - self.queries[open_]
            diff[ahead[open_]] = 0
            sign = diff[np.arange(len(open_)), (diff != 0).argmax(axis=1)]
            less = sign <= 0 if after else sign < 0
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def occurrences(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, place in the shard) of every occurrence."""
        suffixes = self.suffixes(shard)
        if not len(suffixes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = self.search(shard, suffixes, False)
        which, rank = _expand(lo, self.search(shard, suffixes, True) - lo)
        return which, suffixes[rank]

    def longest(self, which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, item, start in the item, words): occurrences that follow each other in document and item, joined."""
        k, row = _expand(self.first_owner[which], self.owners[which])
        place, item, start, n = place[k], self.owner[row], self.start[row], self.length[which[k]]
        order = np.lexsort((place, place - start, item))
        place, item, start, n = place[order], item[order], start[order], n[order]
        new = np.ones(len(place), bool)
        new[1:] = (item[1:] != item[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, len(place)))
        return place[first], item[first], start[first], n[first] + runs - 1


def _shard_rows(index: TestIndex, docs: list[np.ndarray]) -> list[tuple]:
    """(n_words, n_hit, spans, matches) of each document of a shard."""
    sizes = np.array([len(d) for d in docs], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    shard = np.zeros(int(sizes.sum()) + len(docs) + index.window, np.int32)
    for d, b in zip(docs, begins):
        shard[b : b + len(d)] = d
    which, place = index.occurrences(shard)
    rows = [(int(n), 0, [], []) for n in sizes]
    if not len(which):
        return rows
    change = np.zeros(len(shard) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + index.length[which], -1)
    edges = np.diff(np.concatenate(([0], np.cumsum(change) > 0)).astype(np.int8))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    spans: dict[int, list] = {}
    for d, a, b in zip(np.searchsorted(begins, starts, "right") - 1, starts, stops):
        spans.setdefault(int(d), []).append({"start": int(a - begins[d]), "stop": int(b - begins[d])})
    place, item, start, n = index.longest(which, place)
    doc = np.searchsorted(begins, place, "right") - 1
    matches: dict[int, list] = {}
    for d, p, i, s, m in zip(doc.tolist(), (place - begins[doc]).tolist(), item.tolist(), start.tolist(), n.tolist()):
        matches.setdefault(d, []).append({"item_id": index.item_ids[i], "item_start": s, "doc_start": p, "n_words": m})
    for d, found in spans.items():
        rows[d] = (rows[d][0], sum(x["stop"] - x["start"] for x in found), found, matches[d])
    return rows


_built: dict[bytes, TestIndex] = {}


def _index(items: list[tuple[str, bytes]], key: bytes, window: int) -> TestIndex:
    """A worker holds the index of one block at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = TestIndex(items, window)
    return _built[key]


def _match_block(df: DataFrame, items: list[tuple[str, bytes]], text: str, window: int) -> tuple[DataFrame, Broadcast]:
    """df with the matches of the items, and the broadcast to destroy when that has been computed."""
    key = hashlib.sha256(repr((window, items)).encode()).digest()
    sent = df.sparkSession.sparkContext.broadcast(items)

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        index = _index(sent.value, key, window)
        get = index.vocabulary.get
        for (texts,) in batches:
            rows, docs, held = [], [], 0
            for t in text_bytes(texts):
                w = words(t)
                docs.append(np.fromiter((get(x, 0) for x in w), np.int32, len(w)))
                held += len(w)
                if held >= SHARD_WORDS:
                    rows += _shard_rows(index, docs)
                    docs, held = [], 0
            if docs:
                rows += _shard_rows(index, docs)
            yield struct_array([list(c) for c in zip(*rows)] or [[]] * len(_FIELDS), _FIELDS)

    return arrow_apply(df, [ref(text)], _SCHEMA, process), sent


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, dealt by hash into blocks of about ``block_bytes``, one collected at a time."""
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r.item_id, r.text.encode()) for r in items.where(deal == k).sort("item_id", "text").collect()]


def find_contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """df with n_words, n_hit (long), spans (hit words: start, stop) and matches (item_id, item_start, doc_start, n_words).

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one; matches are the longest verbatim runs of at least a window.
    Null texts have no words, items without words have no windows, items that
    repeat are each matched, and those without an id match with a null item_id.  A benchmark of up to ``block_bytes`` takes one
    pass without a shuffle; a larger one takes a pass for each block, whose hits
    are written to the shared folder and joined once.  An item is never split, so
    one of more than ``block_bytes`` is a block of its own.  Rows keep their multiplicity.
    """
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _match_block(df, first, text, window)[0]
    spark, at = df.sparkSession, new_path(df.sparkSession, "hits")
    whole = F.coalesce(ref(text), F.lit(""))
    # A block at a time: its hits are written, by the row's content, and its index is given up before the next one.
    for k, items in enumerate(chain([first, second], blocks)):
        matched, sent = _match_block(df.select(F.xxhash64(whole).alias("__el_h"), F.md5(whole).alias("__el_m"), ref(text)), items, text, window)
        hits = matched.where("n_hit > 0").select("__el_h", "__el_m", "spans", "matches").dropDuplicates(["__el_h", "__el_m"])
        hits.write.parquet(f"{at}/block={k}")
        sent.destroy()
    found = spark.read.schema(hits.schema).parquet(*[f"{at}/block={i}" for i in range(k + 1)])
    found = found.groupBy("__el_h", "__el_m").agg(F.flatten(F.collect_list("spans")).alias("__el_s"), F.flatten(F.collect_list("matches")).alias("__el_x"))
    counted = _match_block(df, [], text, window)[0].drop("n_hit", "spans", "matches")
    joined = counted.withColumns({"__el_h": F.xxhash64(whole), "__el_m": F.md5(whole)}).join(found, ["__el_h", "__el_m"], "left")
    spans = _united(F.coalesce("__el_s", F.array().cast("array<struct<start:int,stop:int>>")))
    out = joined.withColumns({"spans": spans, "matches": F.coalesce("__el_x", F.array().cast(MATCHES))})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return out.withColumn("n_hit", n_hit).drop("__el_h", "__el_m", "__el_s", "__el_x").select(*[ref(c) for c in counted.columns], "n_hit", "spans", "matches")


def _united(spans):
    """Spans as a sorted list without overlaps; touching ones are joined."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when(F.size(done) == 0, F.array(x)).otherwise(
            F.when(x["start"] <= last["stop"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))
        )

    return F.aggregate(F.array_sort(spans), empty, add)


def remove_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """df without the rows that hold any window of the benchmark."""
    found = find_contamination(df.select(*[ref(c).alias(f"__el_{i}") for i, c in enumerate(df.columns)], ref(text).alias("text")), benchmark, **options)
    return found.where("n_hit = 0").select(*[F.col(f"__el_{i}").alias(c) for i, c in enumerate(df.columns)])


def digests(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match."""
    found = find_contamination(df.select("doc_id", "text"), benchmark)
    # Items without an id count as hits, but can't be named.
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest_match"),
    )

"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most two bits apart share a variant one bit or less from
each.  Every distinct fingerprint therefore emits its 65 variants within half
the radius; a shuffle on the variant brings neighbours together, and the few
fingerprints of one variant (65 at most, whatever the data) are linked in a
chain and verified.  Exact copies never multiply: they are one fingerprint.
Components come from rounds of large-star and small-star steps on the linked
fingerprints, all as joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, arrow_apply, checkpoint, ref, struct_array, text_bytes

#: Words of a shingle, seed of its hash, and the most differing bits of a link.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Shares of a node with very many neighbours, so that no task joins all of them.
SALTS = 16
_BITS = [1 << i if i < 63 else -(1 << 63) for i in range(64)]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The text's fingerprint as a signed 64-bit integer (Spark's long)."""
    import xxhash

    w = text.translate(FOLD).split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, seed) for g in grams), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", column: str = "fp") -> DataFrame:
    """Append ``column`` (long).  Null texts and texts without words have fingerprint zero."""

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        for (texts,) in batches:
            yield struct_array([[fingerprint(t) for t in text_bytes(texts)]], [(column, pa.int64())])

    return arrow_apply(df, [ref(text)], T.StructType([T.StructField(column, T.LongType())]), process)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a < b) among the distinct fingerprints of ``fps`` (fp), enough to join all within ``radius`` bits (2).

    A chain through the sorted members of each variant: any two members are
    within one bit of the variant, so every link to another text is in the
    closure of the chain.
    """
    if radius != 2:
        raise ValueError("balls of one bit meet at a radius of two")
    variants = fps.select(
        "fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(b)) for b in _BITS])).alias("v")
    )
    from pyspark.sql import Window

    before = F.lag("fp").over(Window.partitionBy("v").orderBy("fp"))
    return (
        variants.select("fp", before.alias("a"))
        .where(F.col("a").isNotNull())
        .select("a", F.col("fp").alias("b"))
        .distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )


def _join_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    dealt = low.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(dealt, ["u", "salt"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Large-star and small-star steps, each a shuffle of the edges, until an
    iteration changes nothing; every round is cut by a reliable checkpoint.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # large star: every larger neighbour of u goes to u's smallest neighbour (u itself included)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _join_low(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u's neighbours, all smaller, and u itself go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _join_low(large, low)
        edges = checkpoint(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable by links, itself included.

    Texts without words share fingerprint zero, which links like any other.
    Rows without a doc_id have the component of their fingerprint, null where
    nobody in it has an id.  Rows that repeat come back as often.
    """
    return _grouped(df.select("doc_id", ref(text).alias("text"))).select("doc_id", "fp", "component_id")


def _grouped(rows: DataFrame) -> DataFrame:
    """near_duplicates() of (doc_id, text), with text_hash and keeper: what the group's first row is and how often it is there.

    Rows go by doc_id, those without one last, then by the hash of their text.
    """
    docs = checkpoint(with_fingerprint(rows.withColumn("text_hash", F.xxhash64("text"))).select("doc_id", "fp", "text_hash"))
    same = docs.groupBy("fp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "n")
    by_fp = checkpoint(same.groupBy("fp").agg(F.min(row).alias("least")))
    roots = components(links(by_fp.select("fp")))
    rooted = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    groups = rooted.groupBy("root").agg(F.min("least").alias("keeper"))
    moved = checkpoint(rooted.join(groups, "root").select("fp", "keeper"))
    # A fingerprint that many copies share is a hot key of docs: AQE splits it, for the other side has one row for each.
    return docs.join(moved, "fp", "left").select("doc_id", "fp", F.col("keeper.doc_id").alias("component_id"), "text_hash", "keeper")


def drop_near_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """df with one row of each group: of the smallest doc_id, of several texts of that id the one of the least hash.

    A doc_id of several texts loses those that are in another's group, or not
    its first in the group.  A row that repeats stays once.  Rows without an id
    are grouped like any other, and stay where nobody in the group has one.
    """
    found = _grouped(df.select("doc_id", ref(text).alias("text")))
    first = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & F.col("text_hash").eqNullSafe(F.col("keeper.text_hash"))
    named = [F.col("doc_id").alias("__el_id"), F.col("text_hash").alias("__el_h")]
    here = F.col("doc_id").eqNullSafe(F.col("__el_id")) & F.xxhash64(ref(text)).eqNullSafe(F.col("__el_h"))
    kept = df.join(found.where(~first).select(*named).distinct(), here, "left_anti")
    often = checkpoint(found.where(first & (F.col("keeper.n") > 1)).select(*named).distinct())
    if often.isEmpty():
        return kept
    once = kept.join(often, here, "left_semi").dropDuplicates(["doc_id", text])
    return kept.join(often, here, "left_anti").unionByName(once)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Secret scans with multipart credential linking.

Single patterns report what is a secret by itself.  Weak candidates, which
alone are noise, are reported only where complementary parts co-occur: access
identifiers, secrets and endpoints of one text are joined where their intervals
fall into one scope, and a link that has an identifier and a secret, or a
secret and an endpoint, reports its weak members.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_apply, ref, struct_array

#: Code points that may lie between parts of one credential, and fewest bits of entropy of a weak secret's character.
SCOPE, MIN_ENTROPY = 200, 3.2

# The base patterns and the fewest characters of a match (of group 2 for assign).
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Of [0-9a-f]+ those of 24 and more: both find maximal runs.
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint"]

# Weak parts of a credential, of any length: a span is the whole run.
_WEAK_ID = re.compile(r"""(?i:client_?id|user(?:name)?|login|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII)
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
_WEAK_ENDPOINT = re.compile(r"https?://[^\s\"'<>]{4,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in (s.count(c) for c in set(s)))


def _outside(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of ``taken``."""
    taken = sorted(taken)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))
    return [(a, b) for a, b in spans if not (k := bisect_left(starts, b)) or reach[k - 1] <= a]


def _near(parts: list[tuple[int, int]], others: list[tuple[int, int]], scope: int) -> list[tuple[int, int]]:
    """The parts that lie beside one of ``others``, without overlap, at most ``scope`` away.  An interval join by binary search."""
    starts, stops = sorted(a for a, _ in others), sorted(b for _, b in others)

    def joined(a: int, b: int) -> bool:
        before, after = bisect_right(stops, a), bisect_left(starts, b)
        return (before > 0 and stops[before - 1] >= a - scope) or (after < len(starts) and starts[after] <= b + scope)

    return [(a, b) for a, b in parts if joined(a, b)]


def candidates(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """(identifiers, secrets, endpoints), the weak ones, none of which overlaps another.

    Endpoints claim their text first, then identifiers, then secrets; a secret
    overlaps no base span either.
    """
    ends = [m.span() for m in _WEAK_ENDPOINT.finditer(text)] if "://" in text or "." in text else []
    ids = _outside([m.span() for m in _WEAK_ID.finditer(text)], ends)
    if not (ids or ends or any(k == 1 for _, k, _ in base)):
        return ids, [], ends
    runs = _outside([m.span() for m in _WEAK_SECRET.finditer(text)], [*ends, *ids, *((a, b) for a, _, b in base)])
    return ids, [(a, b) for a, b in runs if _secret_like(text[a:b])], ends


def _secret_like(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= MIN_ENTROPY


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak candidates that a complementary part confirms.

    A secret is confirmed by an identifier or an endpoint, either of these by a
    secret; base spans take part as what they are (an access key is an
    identifier, the others are secrets).  Parts are disjoint: nothing confirms
    itself, or what it lies in.
    """
    ids, weak, ends = candidates(text, base)
    every_id = ids + [(a, b) for a, k, b in base if k == 1]
    secrets = weak + [(a, b) for a, k, b in base if k != 1]
    found = [(3, ids, secrets), (4, weak, every_id + ends), (5, ends, secrets)]
    return sorted((a, kind, b) for kind, parts, others in found if parts and others for a, b in _near(parts, others, scope))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("linked", pa.bool_())])
_OUT = T.StructType(
    [
        T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("linked", T.BooleanType())])))
    ]
)


def find_secrets(df: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Append secrets: kind, start and stop in code points (stop exclusive) and linked (a weak part that was confirmed), by start, then kind.

    Null and empty texts have none.  Row-local: no shuffle; repeated rows each give theirs.
    """

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        for (texts,) in batches:
            rows = []
            for t in texts:
                s = t.as_py() or ""
                base = base_spans(s)
                rows.append([{"kind": KINDS[k], "start": a, "stop": b, "linked": k > 2} for a, k, b in sorted(base + linked_spans(s, base, scope))])
            yield struct_array([rows], [("secrets", pa.list_(_SPAN))])

    return arrow_apply(df, [ref(text)], _OUT, process)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    found = find_secrets(df.select("doc_id", "text")).select("doc_id", "secrets")
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(said(F.filter("secrets", lambda x: ~x["linked"])).cast("binary"), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda x: x["linked"])).cast("long").alias("n_linked"),
    )

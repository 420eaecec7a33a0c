"""Quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows.

Every document's rule statistics are taken once, over its whole text, and kept
as a narrow table.  Trees of random splits over statistics of labelled good
documents isolate a document that is unlike them after few splits; the path
length becomes an anomaly score.  The threshold is the one that best separates
all labelled rows, among those that keep nearly all good ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, arrow_apply, checkpoint, draw, ref, struct_array

#: The fit's documented bounds: good labelled documents that the forest is grown from, trees, and documents of a tree.
FIT_ROWS, TREES, TREE_ROWS = 8192, 100, 512
#: Share of good labelled documents that a threshold must keep, and bins of the score histogram that it is read from.
KEEP_GOOD, BINS = 0.998, 4096
#: Base rule: fewest words, and most words in repeated windows per hundred.
MIN_WORDS, MAX_REPEATS, WINDOW = 10, 20, 5
_SYMBOLS = b"#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest sees: each rule's statistic from 0 to 1, so that length alone doesn't tell.
FEATURES = ["symbols", "dup_lines", "repeats", "upper", "exclaims"]
#: Ratio of symbols, and of exclamation marks, to word characters that counts as 1.
FULL = 0.1
#: Splits reach so far beyond the values seen: what no good document has is split off at once.
MARGIN = 0.25


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the text, exactly."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    size = len(seen)
    if size == len(words):
        return 0
    if size**window < 1 << 62:
        key = ids[:n].copy()
        for k in range(1, window):
            key = key * size + ids[k : n + k]
    else:  # rank pairs of windows instead, so that the key still is exact
        key, span = ids, 1
        while span < window:
            step = min(span, window - span)
            m = len(key) - step
            key = np.unique(key[:m] * (int(key.max()) + 1) + key[step : step + m], return_inverse=True)[1].reshape(-1)
            span += step
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    change[at] += 1
    change[at + window] -= 1
    return int((np.cumsum(change) > 0).sum())


def statistics(text: str) -> tuple:
    """BASE and FEATURES of a text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    blanks = len(raw) - len(raw.translate(None, SPACES))
    word_chars = len(text) - blanks
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeat_words(words)
    chars = max(1, word_chars)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        n,
        word_chars,
        n_symbols,
        n_dup,
        n_repeat,
        min(1.0, n_symbols / chars / FULL),
        n_dup / max(1, len(lines)),
        n_repeat / max(1, n),
        upper / chars,
        min(1.0, raw.count(b"!") / chars / FULL),
    )


_FIELDS = [(c, pa.int64()) for c in BASE] + [(c, pa.float64()) for c in FEATURES]
_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in BASE] + [T.StructField(c, T.DoubleType()) for c in FEATURES])


def with_statistics(df: DataFrame, text: str = "text", forest: IsolationForest | None = None) -> DataFrame:
    """Append BASE (long) and FEATURES (double), with ``forest`` also anomaly (double).  Null and empty texts have zeros."""
    fields, schema = _FIELDS, _SCHEMA
    if forest is not None:
        fields, schema = [*_FIELDS, ("anomaly", pa.float64())], T.StructType([*_SCHEMA.fields, T.StructField("anomaly", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(forest)

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        for (texts,) in batches:
            columns = [list(c) for c in zip(*(statistics(t.as_py() or "") for t in texts))] or [[]] * len(_FIELDS)
            if sent.value is not None:
                columns.append(sent.value.score(np.column_stack(columns[len(BASE) :]).astype(float)))
            yield struct_array(columns, fields)

    return arrow_apply(df, [ref(text)], schema, process)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATS * n_words)


def _path_rest(n: np.ndarray | int):
    """Mean path length of an unsuccessful search among n rows, the usual correction for a leaf of n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as flat arrays: node i splits on feature[i] at value[i] and leads to left[i] or left[i] + 1; leaves have feature -1.

    A split is drawn from a part's range and MARGIN above it, for a rule is broken upwards only.
    """

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    rows: int = 1

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        rows = max(1, min(rows, len(x)))
        grown = [cls._grow(x[rng.choice(len(x), rows, replace=False)], rng) for _ in range(trees)] if len(x) else []
        return cls(grown, rows)

    @staticmethod
    def _grow(x: np.ndarray, rng: np.random.Generator):
        limit = math.ceil(math.log2(max(2, len(x))))
        feature, value, left, path = [-1], [0.0], [0], [0.0]
        stack = [(0, x, 0)]
        while stack:
            at, part, depth = stack.pop()
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
            if len(part) < 2 or depth == limit:
                path[at] = depth + float(_path_rest(len(part)))
                continue
            f = int(rng.integers(x.shape[1]))
            cut = float(rng.uniform(low[f], high[f] + MARGIN))
            feature[at], value[at], left[at] = f, cut, len(feature)
            side = part[:, f] < cut
            for child in (part[side], part[~side]):
                feature.append(-1)
                value.append(0.0)
                left.append(0)
                path.append(0.0)
                stack.append((len(feature) - 1, child, depth + 1))
        return np.array(feature), np.array(value), np.array(left), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score, 0 to 1: 2 to the power of minus the mean path length over the expected one."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            open_ = np.arange(len(x))
            while len(open_):
                node = at[open_]
                inner = feature[node] >= 0
                open_, node = open_[inner], node[inner]
                if len(open_):
                    at[open_] = left[node] + (x[open_, feature[node]] >= value[node])
            total += path[at]
        expected = max(1e-9, float(_path_rest(max(2, self.rows))))
        return np.exp2(-total / len(self.trees) / expected)


def with_anomaly(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """Append anomaly (double)."""
    sent = stats.sparkSession.sparkContext.broadcast(forest)

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
            yield struct_array([sent.value.score(x)], [("anomaly", pa.float64())])

    return arrow_apply(stats, [F.col(c) for c in FEATURES], T.StructType([T.StructField("anomaly", T.DoubleType())]), process)


def fit_forest(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> IsolationForest:
    """From at most ``fit_rows`` labelled good documents that pass the base rule, drawn by the hash of their id."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    passed = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(good, "doc_id", "left_semi")
    drawn = draw(passed, fit_rows, *FEATURES).select(*FEATURES).collect()
    return IsolationForest.fit(np.array([list(r) for r in drawn], float).reshape(-1, len(FEATURES)))


def calibrate(scored: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD, bins: int = BINS) -> float:
    """The anomaly score above which a document goes, from a histogram of all labelled rows that pass the base rule.

    The best balanced accuracy among thresholds that keep ``keep_good`` of the
    good rows.  Without labels of both kinds nothing goes.
    """
    of = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = (
        scored.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .join(of, "doc_id")
        .groupBy(F.least(F.floor(F.col("anomaly") * bins), F.lit(bins - 1)).cast("int").alias("bin"), "quality")
        .count()
        .collect()
    )
    good, bad = np.zeros(bins), np.zeros(bins)
    for r in rows:
        (good if r.quality == 1 else bad)[r.bin] += r["count"]
    if not good.sum() or not bad.sum():
        return 1.0
    kept, gone = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    able = np.flatnonzero(kept >= keep_good)
    best = able[np.argmax((kept + gone)[able])]
    return float(best + 1) / bins


@dataclass
class QualityRules:
    """A fitted forest and its threshold."""

    forest: IsolationForest
    threshold: float

    def verdict(self, stats: DataFrame) -> DataFrame:
        """Append base_failed and kept to a table of statistics and anomaly."""
        failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
        return stats.withColumns({"base_failed": failed, "kept": ~failed & (F.col("anomaly") < self.threshold)})


def fit(stats: DataFrame, labels: DataFrame) -> QualityRules:
    forest = fit_forest(stats, labels)
    return QualityRules(forest, calibrate(with_anomaly(stats, forest), labels))


def judge(df: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, BASE, FEATURES, anomaly, base_failed and kept of every row.

    Texts without words fail the base rule.  Rows without labels are judged like
    others; a doc_id labelled twice counts as good if any label says so.  Rows
    that repeat come back as often.
    """
    stats = checkpoint(with_statistics(df.select("doc_id", ref(text).alias("text")), "text").drop("text"))
    rules = fit(stats, labels)
    return rules.verdict(with_anomaly(stats, rules.forest))


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """df without the rows that are rejected.  Statistics are taken a second time, so that texts never move."""
    stats = checkpoint(with_statistics(df.select("doc_id", ref(text).alias("text")), "text").drop("text"))
    rules = fit(stats, labels)
    plain = df.select(*[ref(c).alias(f"__el_{i}") for i, c in enumerate(df.columns)], ref(text).alias("__el_text"))
    judged = rules.verdict(with_statistics(plain, "__el_text", rules.forest)).where("kept")
    return judged.select(*[F.col(f"__el_{i}").alias(c) for i, c in enumerate(df.columns)])


def digests(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, BASE, base_failed, kept, anomaly."""
    return judge(df, labels).select("doc_id", *BASE, "base_failed", "kept", "anomaly")

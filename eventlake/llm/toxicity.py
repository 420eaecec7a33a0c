"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel compares short strings by the subsequences of three characters that
they share, each weighted by a decay for every character that its closest
occurrence spans, so a gap or an inserted character weakens a match without
losing it; the weights of a shared subsequence meet in their minimum (histogram
intersection), so that repeats don't add up to a match.  The machine's kernel is
that to the power POWER, a product of kernels and so a kernel itself:

    K(x, y) = k(x, y) ** POWER

Landmarks are strings that tell toxic documents of the labelled sample.  The
Nyström map takes a string's K with all landmarks to coordinates in which inner
products of landmarks are K itself; a linear machine in them is a weighted sum
of K with the landmarks.  Labels are of documents, insults are words, so training alternates: the word of each
toxic document that the machine finds worst is its witness, with any other that
it finds toxic, the worst words of clean documents are counterexamples, and the
machine is trained anew on them
with squared hinge loss.  A document's score is that of its worst word,
calibrated to a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, arrow_apply, checkpoint, draw, id_remainder, ref, struct_array, text_bytes

#: Characters of a subsequence are three; it spans SPAN at most, each character of the span decays it by DECAY.
SPAN, DECAY = 8, 0.8
#: The fit's documented bounds: labelled documents, landmarks, candidates that landmarks are chosen from.
FIT_ROWS, LANDMARKS, CANDIDATES = 8000, 64, 600
#: Rounds of training, and words of a document that each looks at.
ROUNDS, WORST = 3, 6
#: Share of a landmark's subsequences from which a string is another form of it; before the first round such words are toxic.
SAME = 0.85
#: Distinct toxic documents that must hold a landmark, how much rarer it must be in clean ones, and its evidence: chance gives
#: a string so large a share of toxic ones with a probability of exp(-MIN_EVIDENCE) at most (6e-6).
MIN_ROWS, MIN_RATIO, MIN_EVIDENCE = 4, 10, 12.0
#: Power of the kernel: chance matches fade, near matches stay.
POWER = 3.0
#: Remainder of crc32(doc_id) mod 5 of the rows that are held out; score from which a document is predicted toxic.
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Longest string compared at once; longer words are compared in overlapping parts.
PART = 24
#: Words that a worker remembers, and bytes of text compared at once.
WORD_CACHE, CHUNK = 150_000, 2 << 20

_PAD = b"\0" * (SPAN - 1)
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Letters spaced out: a run of three or more words of one character is also read as one.
_SPACED = re.compile(rb"(?<![^\s])[^\s](?:\s[^\s]){2,}(?![^\s])")
_EDGES = b".,;:!?\"'()[]{}|*#$%&<>"


def units(text: bytes) -> set[bytes]:
    """The distinct strings of a text that are compared: words, and runs of single characters as one."""
    low = text.translate(FOLD)
    found = set(low.split())
    for m in _SPACED.finditer(low):
        found.add(b"".join(m.group().split()))
    out = set()
    for w in found:
        w = w.strip(_EDGES)
        if len(w) <= PART:
            out.add(w)
        else:
            out.update(w[i : i + PART] for i in range(0, len(w) - PART // 2, PART // 2))
    out.discard(b"")
    return out


class SubsequenceKernel:
    """Kernel values of many strings with a fixed set of landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        counts = np.bincount(np.frombuffer(b"".join(landmarks) or b"\0", np.uint8), minlength=256)
        known = [b for b in np.argsort(-counts, kind="stable") if counts[b] and b]
        self.code = np.zeros(256, np.int32)
        self.code[known] = np.arange(1, len(known) + 1)
        self.base = base = len(known) + 1
        grams: dict[int, dict[int, float]] = {}
        for j, word in enumerate(landmarks):
            c = self.code[np.frombuffer(word, np.uint8)]
            for d1, d2 in _OFFSETS:
                for i in range(len(c) - d2):
                    a, b, e = int(c[i]), int(c[i + d1]), int(c[i + d2])
                    if a and b and e:
                        row = grams.setdefault((a * base + b) * base + e, {})
                        row[j] = max(row.get(j, 0.0), DECAY ** (d2 + 1))
        self.row = np.zeros(base**3, np.int32)
        self.weight = np.zeros((len(grams) + 1, len(landmarks)), np.float32)
        for k, (gram, by) in enumerate(grams.items(), 1):
            self.row[gram] = k
            for j, x in by.items():
                self.weight[k, j] = x
        self.own = np.maximum(1e-9, np.diag(self(landmarks))) if landmarks else np.ones(0)

    def __call__(self, strings: list[bytes]) -> np.ndarray:
        """(strings, landmarks) kernel values."""
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        if not strings or not self.landmarks:
            return out
        flat = np.frombuffer(_PAD.join(strings) + _PAD, np.uint8)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + len(_PAD)
        of = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
        c = self.code[flat]
        c1, c2 = c * self.base, c * self.base**2
        n = len(c) - len(_PAD)
        words, rows, decays = [], [], []
        for d1, d2 in _OFFSETS:
            row = self.row[c2[:n] + c1[d1 : n + d1] + c[d2 : n + d2]]
            at = np.flatnonzero(row)
            words.append(of[at])
            rows.append(row[at])
            decays.append(np.full(len(at), DECAY ** (d2 + 1), np.float32))
        word, row, decay = map(np.concatenate, (words, rows, decays))
        if not len(word):
            return out
        # The closest occurrence of each subsequence of each string.
        key = word.astype(np.int64) * len(self.weight) + row
        order = np.argsort(key, kind="stable")
        key, decay = key[order], decay[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        decay = np.maximum.reduceat(decay, first)
        word, row = np.divmod(key[first], len(self.weight))
        for i in range(0, len(word), 1 << 17):
            w = word[i : i + (1 << 17)]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            shared = np.minimum(self.weight[row[i : i + (1 << 17)]], decay[i : i + (1 << 17), None])
            out[w[first]] += np.add.reduceat(shared, first, axis=0)
        return out

    def powered(self, strings: list[bytes]) -> np.ndarray:
        """(strings, landmarks) values of the machine's kernel K."""
        return self(strings).astype(float) ** POWER

    def share(self, strings: list[bytes]) -> np.ndarray:
        """What each string has of each landmark, from 0 to 1 where it holds all of its subsequences."""
        return self(strings) / self.own


def nystroem(kernel: SubsequenceKernel) -> np.ndarray:
    """The map from K with the landmarks to coordinates: the inverse root of the landmarks' gram matrix, where it has rank."""
    gram = kernel.powered(kernel.landmarks)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    kept = value > 1e-8 * value.max()
    return vector[:, kept] / np.sqrt(value[kept])


@dataclass
class ToxicityModel:
    """The machine over units of text: weights of K with each landmark, a bias, a calibration.

    Without weights, as before the first round, the margin is how far the unit is another form of any landmark.
    """

    landmarks: list[bytes]
    weights: np.ndarray | None
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def margins(self, kernel: SubsequenceKernel, strings: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return kernel.share(strings).max(axis=1, initial=0.0) - SAME
        return kernel.powered(strings) @ self.weights + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * np.asarray(margin) + self.shift, -60, 60)))


class Margins:
    """The machine's margin of each unit, with a bounded memory."""

    def __init__(self, model: ToxicityModel):
        self.model, self.kernel, self.known = model, SubsequenceKernel(model.landmarks), {}

    def learn(self, found: set[bytes]) -> None:
        new = list(found - self.known.keys())
        if len(self.known) + len(new) > WORD_CACHE:
            self.known.clear()
            new = list(found)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.known.update(zip(part, self.model.margins(self.kernel, part).tolist()))

    def worst(self, docs: list[set[bytes]]) -> list[float]:
        """The largest margin of each document's units; that of nothing, the bias, where it has none."""
        self.learn(set().union(*docs))
        get = self.known.__getitem__
        return [max(map(get, d), default=self.model.bias) for d in docs]


def _gapped(word: bytes) -> bytes:
    """The word with one character more in its middle, chosen by the word itself."""
    k = sum(word)
    return word[: len(word) // 2] + bytes([b"-*.xz_"[k % 6]]) + word[len(word) // 2 :]


def _witnesses(df: DataFrame, model: ToxicityModel) -> DataFrame:
    """Append worst (double), the document's margin, and units (array of binary) and margins, its WORST units from the worst on."""
    fields = [("worst", pa.float64()), ("units", pa.list_(pa.binary())), ("margins", pa.list_(pa.float64()))]

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        margins = Margins(model)
        for (texts,) in batches:
            worst, named, each = [], [], []
            for t in text_bytes(texts):
                found = units(t)
                worst += margins.worst([found])
                named.append(sorted(found, key=lambda u: (-margins.known[u], u))[:WORST])
                each.append([margins.known[u] for u in named[-1]])
            yield struct_array([worst, named, each], fields)

    out = [T.StructField("worst", T.DoubleType()), T.StructField("units", T.ArrayType(T.BinaryType())), T.StructField("margins", T.ArrayType(T.DoubleType()))]
    return arrow_apply(df, [ref("text")], T.StructType(out), process)


def choose_landmarks(sample: DataFrame, n: int = LANDMARKS, candidates: int = CANDIDATES) -> list[bytes]:
    """Strings that tell toxic rows of ``sample`` (doc_id, text, toxic): words and their beginnings by log-likelihood ratio.

    The counts are an aggregate of the executors; the driver gets the best ``candidates``, and keeps those that
    neither hold nor are held by one kept before.
    """

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        for (texts,) in batches:
            rows = []
            for t in text_bytes(texts):
                found = set()
                for w in units(t):
                    if 3 <= len(w) <= 12:
                        found.add(w)
                    found.update(w[:k] for k in (4, 5, 6, 7) if len(w) > k)
                rows.append([w.hex() for w in found])
            yield struct_array([rows], [("strings", pa.list_(pa.string()))])

    # Copies of one document are no evidence: of rows with one label, number of words and least word hash, the first id's counts.
    split = F.split(F.coalesce("text", F.lit("")), r"\s+")
    copies = ["toxic", F.size(split).alias("n"), F.array_min(F.transform(split, lambda w: F.xxhash64(w))).alias("h")]
    sample = sample.groupBy(*copies).agg(F.min_by("text", "doc_id").alias("text"))
    found = arrow_apply(sample.select("text", "toxic"), [ref("text")], T.StructType([T.StructField("strings", T.ArrayType(T.StringType()))]), process)
    counts = found.select("toxic", F.explode("strings").alias("s")).groupBy("s").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    size = sample.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()
    pos, neg = max(1, size.a or 0), max(1, size.b or 0)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    # Documents with the string, surprise at how much likelier it is in toxic ones.
    gain = F.col("a") * F.log((a / pos) / (b / neg))
    # Chernoff's bound, to the power of e: how unlikely so many toxic ones are, among those with the string, at the sample's share.
    n_with = F.col("a") + F.col("b")
    seen = lambda k, share: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n_with * share))).otherwise(0.0)
    evidence = seen("a", pos / (pos + neg)) + seen("b", neg / (pos + neg))
    best = counts.where((F.col("a") >= MIN_ROWS) & (a / pos > MIN_RATIO * b / neg) & (evidence >= MIN_EVIDENCE)).withColumn("gain", gain)
    rows = best.orderBy(F.desc("gain"), F.length("s").desc(), "s").limit(candidates).collect()
    strings = [bytes.fromhex(r.s) for r in rows]
    if not strings:
        return []
    kernel = SubsequenceKernel(strings)
    share = kernel.share(strings)  # what i has of j
    kept: list[int] = []
    for i in range(len(strings)):
        if len(kept) < n and all(share[i, j] < SAME and share[j, i] < SAME for j in kept):
            kept.append(i)
    return [strings[i] for i in kept]


def _machine(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton's method on the violating rows; classes weigh alike."""
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    x1 = np.column_stack([x, np.ones(len(x))])
    pull = np.full(x1.shape[1], ridge)
    pull[-1] = 1e-6
    w, before = np.zeros(x1.shape[1]), None
    for _ in range(50):
        bad = sign * (x1 @ w) < 1
        if before is not None and (bad == before).all():
            break
        before = bad
        xs, cs = x1[bad], cost[bad]
        w = np.linalg.solve((xs * cs[:, None]).T @ xs + np.diag(pull), xs.T @ (cs * sign[bad]))
    return w[:-1], float(w[-1])


def fit(df: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """From at most ``fit_rows`` labelled rows outside the held-out fold, drawn by the hash of their id.

    A doc_id labelled twice is toxic if any label says so; one of several texts
    counts with the least of them, so that ``fit_rows`` bounds rows as well.
    Without both labels the score is the share of toxic ones.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    drawn = draw(known, fit_rows)
    # fit_rows bounds this side: two numbers a row.
    # The sample is stored, for each round reads it, and the whole table is read once.
    sample = checkpoint(df.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    landmarks = choose_landmarks(sample)
    model = ToxicityModel(landmarks, None)
    kernel = SubsequenceKernel(landmarks)
    clean: set[bytes] = set()
    rows = _witnesses(sample, model).select("doc_id", "toxic", "worst", "units", "margins").collect()
    y = np.array([r.toxic for r in rows], float)
    if not landmarks or not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return ToxicityModel(landmarks, np.zeros(len(landmarks)), 0.0, 0.0, float(np.log(share / (1 - share))))
    coordinates = nystroem(kernel)
    for _ in range(ROUNDS):
        clean.update(bytes(u) for r in rows if not r.toxic for u in r.units)
        toxic = {bytes(u) for r in rows if r.toxic for u, m in zip(r.units, r.margins) if m > 0 or m == r.worst}
        witness = sorted(toxic - clean)
        strings = [*witness, *sorted(clean)]
        x = kernel.powered([*strings, *map(_gapped, strings)]) @ coordinates
        w, bias = _machine(x, np.tile(np.arange(len(strings)) < len(witness), 2).astype(float))
        model = ToxicityModel(landmarks, coordinates @ w, bias)
        rows = _witnesses(sample, model).select("doc_id", "toxic", "worst", "units", "margins").collect()
    # Toxic documents enter the calibration as they are, and every fourth as its witnesses would be with a character inserted.
    gapped = [max(model.margins(kernel, [_gapped(bytes(u)) for u in r.units]), default=bias) for r in sorted(rows, key=lambda r: r.doc_id) if r.toxic][::4]
    margin = np.array([*(r.worst for r in rows), *gapped], float)
    model.scale, model.shift = _platt(margin, np.array([*(r.toxic for r in rows), *[1] * len(gapped)], float))
    return model


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration with the usual softened targets."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.column_stack([z, np.ones(len(z))]), np.array([2.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-3 * (w - [2.0, 0.0]))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def with_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Append score (0 to 1, higher: label 1 likelier).  Null and empty texts have no words.  Row-local."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        model = sent.value
        margins = Margins(model)
        for (texts,) in batches:
            worst, docs, held = [], [], 0
            for t in text_bytes(texts):
                docs.append(units(t))
                held += len(t)
                if held >= CHUNK:
                    worst += margins.worst(docs)
                    docs, held = [], 0
            worst += margins.worst(docs)
            yield struct_array([model.probability(np.array(worst, float))], [("score", pa.float64())])

    return arrow_apply(df, [ref(text)], T.StructType([T.StructField("score", T.DoubleType())]), process)


def digests(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = with_toxicity(df.select("doc_id", "text"), fit(df, labels))
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

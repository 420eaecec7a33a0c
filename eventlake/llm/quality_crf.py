"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad; its features are those of the line and of its two
neighbours.  The field's potentials are u_i = w x_i for a good line, 0 for a bad
one, and ``stay`` for two neighbours that agree:

    log P(y | x) = sum_i y_i u_i + stay * #(i: y_i = y_i+1) - log Z(x)

It is fitted to the largest of

    sum_d v_d log P(y_d | x_d) - RIDGE / 2 D |w|^2 - STAY_RIDGE / 2 D stay^2

over D labelled documents, v_d balancing the classes and letting a document
count as eight lines at most.  Labels are of documents: all lines of a good one
are good; of a bad one those are bad that the field of the round before doesn't
find good, one line at least, and in the first round all.  So the chain learns
from runs of good and bad lines how they follow each other.

Forward-backward gives each line's marginal and label; the document's score is
the marginals' mean weighted by line length, put through a calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_apply, checkpoint, draw, id_remainder, ref, struct_array

#: The fit's documented bounds: labelled documents, and lines of one of them on average; a document is drawn whole or not.
FIT_ROWS, FIT_LINES = 6000, 50
#: Rounds of the fit, and widths of the two priors.
ROUNDS, RIDGE, STAY_RIDGE = 2, 1e-3, 0.02
#: Bytes and lines of a text that are worked on at once.
PART_BYTES, PART_LINES = 4 << 20, 1 << 16
#: Lines of a group of chains, with padding, unless one chain alone has more.
PADDED_LINES = 256 * 200
#: Remainder of crc32(doc_id) mod 4 of the rows that are held out.
FOLDS, HELD_OUT = 4, 2
#: Score from which a document is predicted good.
THRESHOLD = 0.7

_UPPER, _DIGITS, _SYMBOLS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?;:~^=_@/\\"
LOCAL = 11
#: Local features of a line and its two neighbours, two border flags, a constant.
WIDTH = 3 * LOCAL + 3


def _line(raw: bytes, words: list[bytes], seen: int) -> tuple[float, ...]:
    n, chars = len(words), max(1, len(raw))
    distinct = len(set(words))
    sizes = [len(w) for w in words]
    return (
        min(8.0, np.log1p(n)),
        sum(sizes) / n / 10 if n else 0.0,
        (len(raw) - len(raw.translate(None, _UPPER))) / chars,
        (len(raw) - len(raw.translate(None, _DIGITS))) / chars,
        min(1.0, 8 * (len(raw) - len(raw.translate(None, _SYMBOLS))) / chars),
        min(1.0, 8 * (len(raw) - len(raw.translate(None, _MARKS))) / chars),
        distinct / n if n else 1.0,
        1.0 - 1.0 / (1 + seen),
        float(n == 0),
        max(sizes) / chars if n else 0.0,
        min(1.0, 8 * (raw.count(b".") + raw.count(b",")) / chars),
    )


def _lines(raw: bytes) -> Iterator[list[bytes]]:
    """The text's lines in parts of bounded size (a longer line is a part of its own)."""
    at = 0
    while at <= len(raw):
        end = raw.find(b"\n", min(at + PART_BYTES, len(raw)))
        end = len(raw) if end < 0 else end
        lines = raw[at:end].split(b"\n")
        for i in range(0, len(lines), PART_LINES):
            yield lines[i : i + PART_LINES]
        at = end + 1


def feature_parts(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of every line, its weight), part by part: weights are code units, one at least."""
    seen: dict[bytes, int] = {}

    def local() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lines in _lines(text.encode()):
            rows = []
            for raw in lines:
                words = raw.split()
                k = seen.get(raw, 0) if words else 0
                if words:
                    seen[raw] = k + 1
                rows.append(_line(raw, words, k))
            yield np.array(rows), np.array([max(1, len(raw)) for raw in lines], float)

    parts = local()
    (x, weight), before = next(parts), None
    while x is not None:
        after, more = next(parts, (None, None))
        out = np.zeros((len(x), WIDTH))
        out[:, :LOCAL] = x
        out[1:, LOCAL : 2 * LOCAL] = x[:-1]
        out[:-1, 2 * LOCAL : 3 * LOCAL] = x[1:]
        if before is not None:
            out[0, LOCAL : 2 * LOCAL] = before
        if after is not None:
            out[-1, 2 * LOCAL : 3 * LOCAL] = after[0]
        out[0, -3], out[-1, -2], out[:, -1] = before is None, after is None, 1.0
        yield out, weight
        before, x, weight = x[-1], after, more


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """feature_parts() of a text in one."""
    x, w = zip(*feature_parts(text))
    return np.concatenate(x), np.concatenate(w)


def _bent(x: np.ndarray) -> np.ndarray:
    """Each feature and its square: a line is odd at either end of a feature's range."""
    return np.concatenate([x, x[:, : 3 * LOCAL] ** 2], axis=1)


@dataclass
class LineCrf:
    """weights: score of good against bad for each feature; stay: reward of two neighbours that agree; scale, shift: calibration."""

    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    stay: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def potentials(self, x: np.ndarray) -> np.ndarray:
        return ((_bent(x) - self.mean) / self.spread) @ self.weights

    def marginals(self, u: np.ndarray) -> np.ndarray:
        return chain_marginals(u, self.stay)

    def raw_score(self, x: np.ndarray, weight: np.ndarray) -> float:
        return float(self.marginals(self.potentials(x)) @ weight / weight.sum())

    def lines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(P(good) of each line, its weight).  A very long text takes about 50 bytes a line beside itself."""
        u, weight = zip(*((self.potentials(x), w) for x, w in feature_parts(text)))
        return self.marginals(np.concatenate(u)), np.concatenate(weight)

    def calibrated(self, raw: float) -> float:
        p = min(max(raw, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-(self.scale * np.log(p / (1 - p)) + self.shift))))

    def score(self, text: str) -> float:
        good, weight = self.lines(text)
        return self.calibrated(float(good @ weight / weight.sum()))


def chain_marginals(u: np.ndarray, stay: float) -> np.ndarray:
    """P(good) of each place of a two-state chain.

    The potentials are u_i for good, 0 for bad, and ``stay`` for neighbours that
    agree.  Forward-backward in log odds: one number for each place and
    direction, f' = log((e^{f+s} + 1) / (e^f + e^s)) of f = u + the message.
    """

    def sweep(v: np.ndarray) -> np.ndarray:
        """Messages into each place, from what comes before it."""
        out, m = np.empty(len(v)), 0.0
        for at in range(0, len(v), PART_LINES):
            row = []
            for x in v[at : at + PART_LINES].tolist():
                row.append(m)
                m = _pass(m + x, stay)
            out[at : at + len(row)] = row
        return out

    ahead = sweep(u)
    ahead += sweep(u[::-1])[::-1]
    ahead += u
    return _sigmoid(ahead)


def _pass(f: float, s: float) -> float:
    import math

    up = f + s if f + s > 0 else 0.0
    top = up + math.log1p(math.exp(-abs(f + s)))
    low = f if f > s else s
    return top - low - math.log1p(math.exp(-abs(f - s)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _batch_marginals(u: np.ndarray, mask: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray]:
    """Of many chains, padded to one length: (P(good) of each place, expected number of neighbours that agree in each chain)."""
    d, n = u.shape
    ahead, back = np.zeros((d, n)), np.zeros((d, n))
    step = lambda f: np.logaddexp(f + stay, 0) - np.logaddexp(f, stay)
    for i in range(1, n):
        ahead[:, i] = step(ahead[:, i - 1] + u[:, i - 1]) * mask[:, i]
    for i in range(n - 2, -1, -1):
        back[:, i] = step(back[:, i + 1] + u[:, i + 1]) * mask[:, i + 1]
    good = _sigmoid(u + ahead + back)
    a, b = (u + ahead)[:, :-1], (u + back)[:, 1:]
    agree = _sigmoid(np.logaddexp(stay + a + b, stay) - np.logaddexp(a, b)) * mask[:, 1:]
    return good, agree.sum(axis=1)


@dataclass
class _Chains:
    """Chains of about one length, padded: features, which places are lines, labels of lines, weight of each chain."""

    x: np.ndarray
    mask: np.ndarray
    y: np.ndarray
    v: np.ndarray


def gradient(w: np.ndarray, stay: float, chains: _Chains) -> tuple[np.ndarray, float]:
    """Of the weighted log-likelihood: what the labels have less what the field expects, of features and of agreement."""
    u = (chains.x @ w).reshape(chains.mask.shape)
    good, agree = _batch_marginals(u, chains.mask, stay)
    rest = (chains.y - good) * chains.mask * chains.v[:, None]
    same = (chains.y[:, 1:] == chains.y[:, :-1]) * chains.mask[:, 1:]
    return rest.reshape(-1) @ chains.x, float((same.sum(axis=1) - agree) @ chains.v)


def _chains(docs: list[tuple[np.ndarray, np.ndarray, int]], mean: np.ndarray, spread: np.ndarray) -> Iterator[tuple[list[int], _Chains]]:
    """The documents (by number) in groups of padded chains."""
    share = np.mean([y for *_, y in docs])
    balance = np.array([0.5 / (1 - share), 0.5 / share])
    rest = sorted(range(len(docs)), key=lambda k: len(docs[k][0]))
    while rest:
        part = rest[:1]
        for k in rest[1:256]:
            if len(docs[k][0]) * (len(part) + 1) > PADDED_LINES:
                break
            part.append(k)
        rest = rest[len(part) :]
        n = len(docs[part[-1]][0])
        x, mask = np.zeros((len(part), n, len(mean)), np.float32), np.zeros((len(part), n))
        for i, k in enumerate(part):
            x[i, : len(docs[k][0])] = (_bent(docs[k][0]) - mean) / spread
            mask[i, : len(docs[k][0])] = 1.0
        labels = np.array([docs[k][2] for k in part])
        lines = mask.sum(axis=1)
        yield part, _Chains(x.reshape(-1, len(mean)), mask, labels[:, None] * mask, balance[labels] * np.minimum(lines, 8) / lines)


def fit_crf(docs: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 120, rate: float = 0.1, rounds: int = ROUNDS) -> LineCrf:
    """The field of the largest likelihood (see above), by Adam; then a logistic calibration of the documents' scores.

    ``docs``: (features, weights, label).  Without both labels the score is the
    share of good ones.
    """
    labels = np.array([y for *_, y in docs])
    width = WIDTH + 3 * LOCAL
    if not len(docs) or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if len(docs) else 0.5, 1e-3, 1 - 1e-3))
        return LineCrf(np.zeros(width), np.zeros(width), np.ones(width), 0.0, 0.0, float(np.log(share / (1 - share))))
    n = sum(len(x) for x, *_ in docs)
    mean = sum(_bent(x).sum(axis=0) for x, *_ in docs) / n
    spread = np.sqrt(sum(((_bent(x) - mean) ** 2).sum(axis=0) for x, *_ in docs) / n)
    mean[WIDTH - 1], spread[spread < 1e-9] = 0.0, 1.0
    spread[WIDTH - 1] = 1.0
    groups = list(_chains(docs, mean, spread))
    w, stay = np.zeros(width), 0.0
    for turn in range(rounds):
        if turn:
            for _, c in groups:
                _relabel(c, w, stay)
        m, v = np.zeros(width + 1), np.zeros(width + 1)
        for t in range(1, steps + 1):
            grad = np.zeros(width + 1)
            for _, c in groups:
                by_w, by_stay = gradient(w, stay, c)
                grad[:-1] += by_w
                grad[-1] += by_stay
            grad /= len(docs)
            grad[:-1] -= RIDGE * w
            grad[-1] -= STAY_RIDGE * stay
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, stay = w + move[:-1], stay + float(move[-1])
    model = LineCrf(w, mean, spread, stay)
    p = np.clip([model.raw_score(x, wt) for x, wt, _ in docs], 1e-6, 1 - 1e-6)
    model.scale, model.shift = _logistic(np.log(p / (1 - p)), labels)
    return model


def _relabel(c: _Chains, w: np.ndarray, stay: float) -> None:
    """Lines of bad documents that the field finds good become good, but for each document's worst."""
    good, _ = _batch_marginals((c.x @ w).reshape(c.mask.shape), c.mask, stay)
    bad = c.y[:, 0] == 0
    worst = np.where(c.mask > 0, good, 2.0).argmin(axis=1)
    found = (good > 0.5) * c.mask
    found[np.arange(len(found)), worst] = 0.0
    c.y[bad] = found[bad]


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of y on z by Newton's method, with a slight pull to zero."""
    x = np.column_stack([z, np.ones(len(z))])
    b = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ b)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(h, x.T @ (y - p) - np.array([1e-2, 1e-4]) * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(df: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_lines: int = FIT_LINES) -> LineCrf:
    """From at most ``fit_rows`` labelled rows outside the held-out fold, drawn by the hash of their id.

    Features are taken by the executors; the driver gets whole documents, of
    ``fit_rows`` times ``fit_lines`` lines at most: a document that exceeds what is
    left is not drawn.  A doc_id labelled twice has its larger label, one of
    several texts counts with the least of them.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    drawn = draw(known, fit_rows)
    schema = T.StructType([T.StructField("x", T.BinaryType()), T.StructField("w", T.BinaryType())])

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        for (texts,) in batches:
            out = []
            for t in texts:
                x, w = line_features(t.as_py() or "")
                out.append((x.astype("<f8").tobytes(), w.astype("<f8").tobytes()))
            yield struct_array([list(c) for c in zip(*out)] or [[], []], [("x", pa.binary()), ("w", pa.binary())])

    # fit_rows bounds this side: two numbers a row.
    texts = checkpoint(df.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n")
    left, out = fit_rows * fit_lines, []
    for r in texts.select("doc_id", lines).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= left:
            left -= r.n
        else:
            out.append(r.doc_id)
    texts = texts.where(~F.col("doc_id").isin(out)) if out else texts
    rows = arrow_apply(texts, [ref("text")], schema, process).select("doc_id", "quality", "x", "w").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    return fit_crf([(np.frombuffer(r.x, "<f8").reshape(-1, WIDTH), np.frombuffer(r.w, "<f8"), int(r.quality == 1)) for r in rows])


def with_quality(df: DataFrame, model: LineCrf, text: str = "text") -> DataFrame:
    """Append score (0 to 1, higher: label 1 likelier), n_lines and n_good (lines more likely good than bad).

    Null and empty texts are one empty line.  Row-local.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    fields = [("score", pa.float64()), ("n_lines", pa.int64()), ("n_good", pa.int64())]

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        for (texts,) in batches:
            rows = []
            for t in texts:
                good, weight = sent.value.lines(t.as_py() or "")
                rows.append((sent.value.calibrated(float(good @ weight / weight.sum())), len(good), int((good > 0.5).sum())))
            yield struct_array([list(c) for c in zip(*rows)] or [[], [], []], fields)

    kinds = [T.DoubleType(), T.LongType(), T.LongType()]
    return arrow_apply(df, [ref(text)], T.StructType([T.StructField(n, k) for (n, _), k in zip(fields, kinds)]), process)


def label_lines(df: DataFrame, model: LineCrf, text: str = "text") -> DataFrame:
    """Append lines: an array of (good, p), the label of each line and its probability of being good, in order."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    line = pa.struct([("good", pa.bool_()), ("p", pa.float64())])

    def process(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.StructArray]:
        for (texts,) in batches:
            rows = [[{"good": x > 0.5, "p": x} for x in sent.value.lines(t.as_py() or "")[0].tolist()] for t in texts]
            yield struct_array([rows], [("lines", pa.list_(line))])

    kind = T.ArrayType(T.StructType([T.StructField("good", T.BooleanType()), T.StructField("p", T.DoubleType())]))
    return arrow_apply(df, [ref(text)], T.StructType([T.StructField("lines", kind)]), process)


def digests(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines, n_good."""
    scored = with_quality(df.select("doc_id", "text"), fit(df, labels))
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_lines",
        "n_good",
    )

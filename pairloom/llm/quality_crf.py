"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are shares of character classes, word statistics, and the
same of the line before and the line behind. Training takes documents with a quality label and
gives each line its document's label. Forward-backward gives each line's marginal; a document's
quality is the mean of the marginals, weighted by the lines' characters that are no white space, and calibrated
by a logistic curve.

Training reads a bounded sample: the `max_train` labelled documents (not held out) that a hash of
their ids puts first, of these the ones of at most `LINES_A_DOCUMENT` lines, and as many as have `MAX_LINES` lines together.
Their line features are made in tasks, and only these reach the driver.
Scoring is one pass over whole texts without a shuffle.

Edge cases: null, empty and blank texts score 0. If the training rows have one class only, or
there are none, every other text scores the share of label 1 (0.5 without rows). Labels other than
0 and 1 are not used, nor are those of a document with both. Of rows that share a doc_id the smallest text is learnt from. Repeated rows give repeated results; an empty table an empty one. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

MAX_TRAIN, THRESHOLD = 4000, 0.3
MAX_LINES, LINES_A_DOCUMENT = 200_000, 2000
STEPS, RATE, L2 = 150, 0.1, 1e-3

UPPER, LOWER, DIGIT, SPACE, SYMBOL, PIPE, BANG, STOP, COMMA, OTHER = range(10)


def _classes() -> np.ndarray:
    kinds = np.full(0x251, OTHER, dtype=np.int64)
    for c in range(0x250):
        s = chr(c)
        kinds[c] = (
            UPPER if s.isupper() else LOWER if s.islower() else DIGIT if s.isdigit() else SPACE if s.isspace() else PIPE if s == "|"
            else BANG if s in "!?" else STOP if s == "." else COMMA if s in ",;:'\"()-" else SYMBOL if s in "#*$%&<>^~@{}[]\\/+=_" else OTHER
        )
    return kinds


KINDS = _classes()
N_FEATURES = 15


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (own, of the line before, of the line behind), their weights, and lines by text."""
    lines: list[str] = []
    per_text, again, distinct, words = [], [], [], []
    for t in texts:
        own = t.split("\n")
        per_text.append(len(own))
        lines += own
        seen: set[str] = set()
        for x in own:
            w = x.split()
            words.append(len(w))
            distinct.append(len(set(w)))
            again.append(len(w) > 0 and x in seen)
            seen.add(x)
    n = len(lines)
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = KINDS[np.minimum(codes, 0x250)]
    length = np.array([len(x) for x in lines], dtype=np.int64)
    row = np.repeat(np.arange(n), length + 1)[: len(codes)]
    count = np.bincount(row * 10 + kinds, minlength=n * 10).reshape(n, 10).astype(np.float64)
    count[:-1, SPACE] -= 1  # the line feeds between
    ink = length - count[:, SPACE]
    letters, w, d = np.maximum(count[:, UPPER] + count[:, LOWER], 1), np.array(words, dtype=np.float64), np.array(distinct, dtype=np.float64)
    some, some_ink = np.maximum(w, 1), np.maximum(ink, 1)
    x = np.stack(
        [
            np.log1p(length) / 8, count[:, UPPER] / letters, count[:, SYMBOL] / some_ink, count[:, DIGIT] / some_ink,
            count[:, PIPE] / some, count[:, BANG] / some, count[:, STOP] / some, count[:, COMMA] / some, ink / some / 10,
            d / some, np.log1p(w) / 6, count[:, OTHER] / some_ink, (w == 0) * 1.0, np.array(again, dtype=np.float64), np.log1p(w - d) / 6,
        ],
        axis=1,
    )
    first = np.zeros(n, dtype=bool)
    last = np.zeros(n, dtype=bool)
    ends = np.cumsum(per_text)
    first[np.r_[0, ends[:-1]]] = True
    last[ends - 1] = True
    before, behind = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], behind[last] = 0, 0
    return np.concatenate([x, before, behind], axis=1), ink, np.array(per_text)


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features and, last, the bias, towards good
    moves: np.ndarray  # 2 x 2 log potentials from a line's label to the next one's
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None  # without a model: every text's score

    def potentials(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)

    def marginals(self, e: list[float]) -> list[float]:
        """P(good) of each line of a document, by forward-backward on the odds."""
        (t00, t01), (t10, t11) = np.exp(self.moves).tolist()
        psi = [exp(v) for v in e]
        forward, r = [], psi[0]
        forward.append(r)
        for p in psi[1:]:
            r = min(max(p * (r * t11 + t01) / (r * t10 + t00), 1e-14), 1e14)
            forward.append(r)
        out, b = [0.0] * len(e), 1.0
        for i in range(len(e) - 1, -1, -1):
            odds = forward[i] * b
            out[i] = odds / (1 + odds)
            q = psi[i] * b
            b = (t10 + t11 * q) / (t00 + t01 * q)
        return out

    def raw(self, texts: list[str]) -> list[float]:
        x, weight, per_text = line_features(texts)
        e, out, at = self.potentials(x).tolist(), [], 0
        for n in per_text.tolist():
            w = weight[at : at + n]
            total = w.sum()
            out.append(float(np.dot(w, self.marginals(e[at : at + n])) / total) if total > 0 else 0.0)
            at += n
        return out

    def score(self, texts: list[str]) -> list[float]:
        if self.constant is not None:
            return [self.constant if t.strip() else 0.0 for t in texts]
        return [calibrated(s, self.slope, self.shift) if t.strip() else 0.0 for s, t in zip(self.raw(texts), texts, strict=True)]


def _logit(s: float) -> float:
    s = min(max(s, 1e-6), 1 - 1e-6)
    return log(s / (1 - s))


def calibrated(s: float, slope: float, shift: float) -> float:
    return 1 / (1 + exp(-min(max(slope * _logit(s) + shift, -30), 30)))


def _expectations(e: np.ndarray, length: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) by document and line, and the summed pair marginals; documents are sorted by length, longest first."""
    n, most = e.shape
    t = np.exp(moves)
    psi = np.exp(np.clip(e, -30, 30))
    active = [int((length > k).sum()) for k in range(most)]
    f = np.ones((n, most))
    f[:, 0] = psi[:, 0]
    for k in range(1, most):
        r = f[: active[k], k - 1]
        f[: active[k], k] = np.clip(psi[: active[k], k] * (r * t[1, 1] + t[0, 1]) / (r * t[1, 0] + t[0, 0]), 1e-14, 1e14)
    b = np.ones((n, most))
    pairs = np.zeros((2, 2))
    for k in range(most - 1, 0, -1):
        a = active[k]
        q, r = psi[:a, k] * b[:a, k], f[:a, k - 1]
        b[:a, k - 1] = (t[1, 0] + t[1, 1] * q) / (t[0, 0] + t[0, 1] * q)
        cell = np.array([[t[0, 0] + 0 * q, t[0, 1] * q], [t[1, 0] * r, t[1, 1] * r * q]])
        pairs += (cell / cell.sum(axis=(0, 1))).sum(axis=2)
    odds = f * b
    return odds / (1 + odds), pairs


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS, rate: float = RATE, l2: float = L2) -> Crf:
    """documents: features by line, weights by line, label. Adam on the regularised log-likelihood."""
    labels = [y for _, _, y in documents]
    if len(set(labels)) < 2:
        return Crf(np.zeros(1), np.ones(1), np.zeros(2), np.zeros((2, 2)), constant=float(labels[0]) if labels else 0.5)
    documents = sorted(documents, key=lambda d: -len(d[0]))
    length = np.array([len(x) for x, _, _ in documents])
    x = np.concatenate([x for x, _, _ in documents]).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    y = np.repeat(np.array([d[2] for d in documents], dtype=np.float64), length)
    doc = np.repeat(np.arange(len(documents)), length)
    line = np.concatenate([np.arange(n) for n in length])
    seen = np.zeros((2, 2))
    for d, n in zip(documents, length, strict=True):
        seen[d[2], d[2]] += n - 1
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        e = np.zeros((len(documents), int(length[0])))
        e[doc, line] = x @ w
        p, pairs = _expectations(e, length, moves)
        g = np.concatenate([(p[doc, line] - y) @ x, (pairs - seen).ravel()]) / len(x) + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    crf = Crf(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    raw, truth = [], []
    for own, weight, label in documents:
        if weight.sum() > 0:
            raw.append(_logit(float(np.dot(weight, crf.marginals(crf.potentials(own).tolist())) / weight.sum())))
            truth.append(label)
    z, t, ab = np.array(raw), np.array(truth, dtype=np.float64), np.array([1.0, 0.0])
    for _ in range(25):  # Newton's method, slightly regularised towards slope 1
        q = 1 / (1 + np.exp(-np.clip(ab[0] * z + ab[1], -30, 30)))
        grad = np.array([((q - t) * z).sum() + (ab[0] - 1), (q - t).sum() + 0.01 * ab[1]])
        s = q * (1 - q)
        hess = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.01]])
        ab = ab - np.linalg.solve(hess, grad)
    crf.slope, crf.shift = float(max(ab[0], 1e-3)), float(ab[1])
    return crf


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Crf:
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    chosen = rows.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # the bound of the sample
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    sample = sample.withColumn("n_lines", n_lines).where(F.col("n_lines") <= LINES_A_DOCUMENT)
    in_order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # of at most max_train rows
    fits = sample.select("doc_id", F.sum("n_lines").over(in_order).alias("so_far")).where(F.col("so_far") <= MAX_LINES).select("doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, weight, _ = line_features([t or ""])
                out.append((q, x.astype(np.float32).tobytes(), weight.astype(np.float32).tobytes()))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["y", "x", "w"])

    found = sample.join(F.broadcast(fits), "doc_id").select("text", F.col("quality").cast("int")).mapInArrow(features, "y int, x binary, w binary").collect()
    documents = [(np.frombuffer(r.x, dtype=np.float32).reshape(-1, 3 * N_FEATURES), np.frombuffer(r.w, dtype=np.float32), r.y) for r in found]
    documents.sort(key=lambda d: (len(d[0]), d[0].tobytes()))
    return fit(documents)


def score(docs: DataFrame, crf: Crf, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                s = crf.score([t or "" for t in part.column(1).to_pylist()])
                predicted = [int(v >= threshold) for v in s]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array(predicted, pa.int32())], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, crf).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")

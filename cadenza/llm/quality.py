"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators: byte 3-grams, 6-grams of character classes, and how far the word and line
n-grams of a text repeat (in bands). Each indicator is scaled by its class log-count ratio, rows are
scaled to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. The model is
fitted on at most ``MAX_ROWS`` labelled rows, evenly from both classes and in the order of a hash of their
ids; a fitted model is two arrays of fixed size. All texts are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents

#: The most labelled rows that a model is fitted on.
MAX_ROWS = 6000
_GRAMS, _SHAPES, _BANDS = 1 << 15, 1 << 13, 48
SIZE = _GRAMS + _SHAPES + _BANDS
_CLASS = np.full(256, 7, np.uint32)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".,;:'?")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 0  # parts of letters beyond ASCII count as lower case
_CLASS[[0xC3]] = 0


def _band(share: float) -> int:
    return min(15, int(share * 16))


def features(text: str) -> np.ndarray:
    """The indices of the indicators that are on, ascending; none for an empty text."""
    on = np.zeros(SIZE, bool)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) > 2:
        code = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        on[(code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)] = True
    if len(b) > 5:
        c = _CLASS[b]
        code = c[:-5].copy()
        for k in range(1, 6):
            code |= c[k : len(c) - 5 + k] << np.uint32(3 * k)
        on[_GRAMS + ((code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 13))] = True
    words = text.split()
    if words:
        at = _GRAMS + _SHAPES
        same = sum(map(str.__eq__, words, words[1:])) / max(1, len(words) - 1)
        lines = [x for x in text.split("\n") if x]
        on[at + _band(same)] = True
        on[at + 16 + _band(len(set(words)) / len(words))] = True
        on[at + 32 + _band(len(set(lines)) / max(1, len(lines)))] = True
    return np.flatnonzero(on)


@dataclass(frozen=True)
class Model:
    """Score of a text with indicators J: 1 / (1 + exp(-(a m + b))), m = sum(w_J) / |ratio_J| + bias."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, on: np.ndarray) -> float:
        norm = float(self.squares[on].sum()) ** 0.5
        return (float(self.weights[on].sum()) / norm if norm else 0.0) + self.bias

    def score(self, on: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(on) + self.b, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Logarithm of the ratio of the smoothed shares of each indicator in class 1 and class 0."""
    counts = np.full((2, SIZE), alpha)
    for on, label in zip(rows, y, strict=True):
        counts[int(label), on] += 1
    per = counts / counts.sum(axis=1, keepdims=True)
    return np.log(per[1] / per[0])


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss (L1-loss SVM) by dual coordinate descent over rows; y is -1 or 1, cost bounds each dual variable."""
    vectors = [ratio[on] / max(1e-12, float(np.sqrt((ratio[on] ** 2).sum()))) for on in rows]
    w, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    random = np.random.default_rng(seed)
    q = np.array([float(v @ v) + 1.0 for v in vectors])  # the bias is a feature that is always on
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            on, v = rows[i], vectors[i]
            slope = y[i] * (float(w[on] @ v) + bias) - 1
            new = min(max(dual[i] - slope / q[i], 0.0), cost[i])
            step = (new - dual[i]) * y[i]
            if step:
                w[on] += step * v
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve over margins by damped Newton steps, with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - 0.7 * step[0], b - 0.7 * step[1]
    return max(a, 1e-3), b


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 4.0) -> Model:
    """Without rows of both classes: a model whose score is the share of class 1, 0.5 without rows."""
    n1 = int(labels.sum())
    if n1 in (0, len(labels)):
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, 30.0 if n1 else (-30.0 if len(labels) else 0.0))

    def fit(idx):
        sub, y = [rows[i] for i in idx], labels[idx]
        ratio = log_count_ratio(sub, y)
        weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
        w, bias = dual_descent(sub, ratio, np.where(y == 1, 1.0, -1.0), cost * weight)
        return Model(w * ratio, ratio**2, bias, 1.0, 0.0)

    folds, margins = np.arange(len(rows)) % 3, np.zeros(len(rows))
    for k in range(3):
        inside = np.flatnonzero(folds != k)
        if 0 < labels[inside].sum() < len(inside):
            part = fit(inside)
            for i in np.flatnonzero(folds == k):
                margins[i] = part.margin(rows[i])
    whole = fit(np.arange(len(rows)))
    return Model(whole.weights, whole.squares, whole.bias, *_platt(margins, labels))


def _indicators(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            packed = [np.packbits(np.isin(np.arange(SIZE), features(t or ""))).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["label", "packed"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on rows of ``labels`` (doc_id, target) outside the held-out third; see `held_out`.

    Null labels and ids are left out; an id with both labels counts in both classes; repeated rows of a label
    count once, of a document each; empty and null texts have no indicators; texts of any length count whole.
    Without rows of both classes the score is the share of class 1, 0.5 without any. Of a class with more than half of ``max_rows``, the rows with the
    smallest hashes of their ids are taken. Only their indicators, a few KB a row, reach the driver.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(target).cast("int").alias("label")).distinct()
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for k in (0, 1)]
    sample = chosen[0].unionAll(chosen[1])  # at most max_rows rows, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text", "doc_id")
    got = rows.repartition(8, "doc_id").select("label", "text").mapInArrow(_indicators, "label int, packed binary").collect()
    got = sorted(((bytes(r["packed"]), r["label"]) for r in got))
    on = [np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8))[:SIZE]) for p, _ in got]
    return fit_rows(on, np.array([x for _, x in got], np.int64))


def held_out(doc_id):
    """Rows that no model may learn from: crc32 of the id's decimal text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` double of every whole text; null texts score as empty ones. A column of that name is replaced, others stay; no rows give no rows."""
    docs = docs.drop("score")
    where = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of fixed size

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = [m.score(features(t or "")) for t in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels outside the held-out third."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

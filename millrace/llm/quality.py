"""Quality scores by support vectors on Naive Bayes features.

Indicators of hashed word and word-shape n-grams are scaled by the classes' log-count
ratios; a linear hinge-loss model over them is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import textvec

BUCKETS = 1 << 18

#: Labelled training texts of each class that the model is fitted on, taken in the order of
#: a hash of doc_id. This bounds what the driver holds; scoring covers every text.
TRAIN_PER_CLASS = 2000

#: An n-gram of fewer training texts says nothing about the class and gets no weight.
MIN_TEXTS = 5

_U = np.uint64


def word_shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A word's look: its last two bytes with letters and digits told apart only by kind,
    whether it starts with a capital or has several, and whether it is one byte long."""
    kind = lambda b: np.where((b - np.uint8(97) < 26) | (b >= 0x80), 1, np.where(b - np.uint8(65) < 26, 2, np.where(b - np.uint8(48) < 10, 3, b.astype(np.int64) + 4)))
    upper = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(raw - np.uint8(65) < 26, out=upper[1:])
    capitals = upper[ends] - upper[starts]
    first, last = raw[starts], kind(raw[ends - 1])
    before = kind(raw[np.maximum(ends - 2, starts)])
    look = (first - np.uint8(65) < 26) + 2 * (capitals > 1) + 4 * (ends - starts == 1)
    return ((last * 512 + before) * 8 + look).astype(np.uint64)


def indicators(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each indicator, bucket of each indicator), every indicator
    once per row: words, pairs of words, and triples of shapes where a word that repeats
    the one before has a shape of its own."""
    for first, words, offsets, shapes in textvec.words_with(texts, word_shapes):
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        place = np.arange(len(words)) - offsets[:-1][rows]
        back = lambda x, d: np.where(place >= d, np.roll(x, d), _U(0))
        previous = back(words, 1)
        shapes = np.where((words == previous) & (place > 0), _U(0xFFFFFF), shapes)
        grams = [
            words,
            textvec.mix(words + previous * _U(3) + _U(1)),
            textvec.mix((shapes << _U(42)) ^ (back(shapes, 1) << _U(21)) ^ back(shapes, 2) ^ (_U(1) << _U(63))),
        ]
        key = np.sort(np.concatenate([(rows * BUCKETS) + (g >> _U(46)).astype(np.int64) for g in grams]))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        yield first, len(offsets) - 1, key // BUCKETS, key % BUCKETS


@dataclass
class Model:
    """margin = sum of weight over a text's indicators / the root of their summed square, + bias."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(rows, weights=self.weight[buckets], minlength=n)
        norm = np.sqrt(np.bincount(rows, weights=self.square[buckets], minlength=n))
        margin = total / np.where(norm > 0, norm, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = {s: np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == s]), minlength=BUCKETS) + 1.0 for s in (1, -1)}
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    return np.where(counts[1] + counts[-1] - 2 >= MIN_TEXTS, ratio, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Linear hinge-loss weights and bias: the dual variable of one example at a time is
    moved to its optimum within [0, cost]. Every x has length 1; the bias is one more
    component of 1."""
    rng = np.random.default_rng(3)
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, v = rows[i], x[i]
            gradient = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (float(v @ v) + 1), 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, with smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = np.array([(weight * (p - target) * margin).sum(), (weight * (p - target)).sum()])
        s = weight * p * (1 - p) + 1e-9
        h = np.array([[(s * margin**2).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """``share``: of label 1 among all labelled training rows; a fifth of the examples is
    kept from the descent to turn margins into probabilities."""
    if not len(rows) or len(set(y.tolist())) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(p / (1 - p))))
    ratio = log_count_ratios(rows, y)
    x = [ratio[r] for r in rows]
    x = [v / (np.sqrt(v @ v) or 1.0) for v in x]
    kept = np.arange(len(rows)) % 5 == 4
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept[:] = False
    fit_on = np.flatnonzero(~kept).tolist()
    w, bias = dual_coordinate_descent([rows[i] for i in fit_on], [x[i] for i in fit_on], y[fit_on])
    shown = np.flatnonzero(kept) if kept.any() else np.arange(len(rows))
    margin = np.array([w[rows[i]] @ x[i] + bias for i in shown])
    up = (y[shown] > 0).mean()
    weight = np.where(y[shown] > 0, share / up, (1 - share) / (1 - up))
    slope, shift = _sigmoid_fit(margin, y[shown], weight)
    return Model(w * ratio, ratio**2, bias, slope, shift)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows that are not held out; a doc_id labelled both ways is left."""
    own = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    counts = {r.quality: r["count"] for r in own.groupBy("quality").count().collect()}
    some = None
    for label in counts:
        part = own.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_PER_CLASS)
        some = part if some is None else some.union(part)
    if some is None:
        return fit([], np.zeros(0), 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, rows, buckets in indicators(b.column("text")):
                offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), b.column("quality").slice(first, n), lists], names=["doc_id", "quality", "x"])

    shown = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    # rows that share a doc_id count as one, so that TRAIN_PER_CLASS bounds texts and not ids
    shown = shown.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("quality").alias("quality"))
    table = shown.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "doc_id long, quality int, x array<int>").toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    y = np.where(table["quality"].to_numpy()[order] == 1, 1, -1)
    lists = table["x"].combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows = [flat[offsets[i] : offsets[i + 1]] for i in order.tolist()]
    share = counts.get(1, 0) / sum(counts.values())
    return fit(rows, y, share)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Only the text feeds a score. At most TRAIN_PER_CLASS labelled texts of each class are
    learned from, none of them held out (crc32 of doc_id mod 3 is 1); of rows that share a
    doc_id the smallest text. Without labels of
    both classes every text has the share of label 1 (0.5 without labels). Empty and null
    texts have no indicators and get the bias alone. Rows with a null doc_id are scored,
    never learned from and not held out. Extra columns are ignored.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, rows, buckets in indicators(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), pa.array(model.score(rows, buckets, n))], names=["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5, all columns kept. Each row is
    judged where it stands: texts go to Python, only scores come back."""
    model = train(docs, labels)

    def scores(texts: pa.Array) -> pa.Array:
        parts = [model.score(rows, buckets, n) for _, n, rows, buckets in indicators(texts)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return docs.where(F.arrow_udf(scores, T.DoubleType())(F.col("text").cast("string")) >= 0.5)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

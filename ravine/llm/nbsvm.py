"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators for a linear SVM.

Features are hashed n-grams: words, word shapes (runs of capitals, letters, digits and other
characters; a word equal to the one before has a shape of its own) and pairs of shapes. Class
counts of the indicators are taken over all training rows, their log ratios scale the indicators,
and a hinge-loss model is fitted by dual coordinate descent on at most ``FIT_ROWS`` training rows
with ``FIT_FEATURES`` features in all, those with the least hash of their key. A logistic curve on
the margins gives the score.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.llm.common import materialize
from ravine.llm.spans import mix

BITS = 18
#: Training rows that the hinge-loss model is fitted on, at most.
FIT_ROWS = 6000
#: Features of these rows, at most, one row after another in the same order.
FIT_FEATURES = 1 << 24
#: Labels are broadcast up to this many rows, joined by shuffle beyond.
FEW_LABELS = 1_000_000
SMOOTH, COST, EPOCHS, THRESHOLD = 1.0, 1.0, 30, 0.3

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUNS = re.compile(r"[^\W\d_]+|\d+|[\W_]+")


def shape(word: str) -> str:
    """A word's runs: A for two capitals or more, Aa, a, 9, and other characters as they are."""
    out = []
    for run in _RUNS.findall(word):
        if run.isalpha():
            out.append("A" if len(run) > 1 and run.isupper() else "Aa" if run[0].isupper() else "a")
        else:
            out.append("9" if run[0].isdigit() else run[:3])
    return "".join(out)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 7)


class Features:
    """Texts to sorted arrays of feature numbers; words seen before come from a table."""

    def __init__(self, bits: int = BITS, size: int = 400_000):
        self.mask, self.size, self.seen = np.uint64((1 << bits) - 1), size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, seen = _WORD.findall(text or ""), self.seen
        if not words:
            return np.empty(0, np.int32)
        if len(seen) > self.size:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = (_hash(w), _hash("\0" + shape(w)))
        both = np.array([seen[w] for w in words], np.uint64)
        plain, shapes = both[:, 0], both[:, 1].copy()
        shapes[1:][plain[1:] == plain[:-1]] = np.uint64(_hash("\0="))
        pairs = mix(shapes[1:] * np.uint64(31) + shapes[:-1])
        found = np.concatenate([np.unique(mix(plain)), np.unique(mix(shapes)), np.unique(pairs)])
        return np.unique((found & self.mask).astype(np.int32))


@functools.cache
def shared_features() -> Features:
    """The worker's table of words, which outlives a task."""
    return Features()


@dataclass
class Model:
    """weights: log-count ratio times SVM weight for each feature; ratio alone for the norm."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        if not len(features):
            return float(1 / (1 + np.exp(-self.offset)))
        norm = np.sqrt(np.square(self.ratio[features]).sum()) or 1.0
        margin = self.weights[features].sum() / norm + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35))))


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0):
    """Hinge loss by dual coordinate descent; rows are scaled to length one. (weights, bias)."""
    rng, w, bias = np.random.default_rng(seed), np.zeros(len(ratio)), 0.0
    values = [ratio[r] / (np.sqrt(np.square(ratio[r]).sum()) or 1.0) for r in rows]
    alpha, square = np.zeros(len(rows)), np.array([np.square(v).sum() + 1 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The logistic curve of labels over margins (regularised targets, Newton steps)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * margins).sum(), g.sum()
        haa, hab, hbb = (h * margins * margins).sum() + 1e-6, (h * margins).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-6:
            break
    return float(a), float(b)


def held_out(key: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, n = shared_features(), np.zeros((2, 1 << BITS), np.int64)
    for b in batches:
        for text, label in zip(b.column(0), b.column(1)):
            n[label.as_py(), features(text.as_py())] += 1
    at = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], names=["feature", "bad", "good"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label, hash, key) to (label, features, size, hash, key)."""
    features = shared_features()
    for b in batches:
        found = [features(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array([f.tobytes() for f in found], pa.binary()), pa.array([len(f) for f in found], pa.int64()), b.column(2), b.column(3)], names=["label", "features", "size", "hash", "row"])


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log-count ratios of the features from their smoothed counts in rows of class 0 and 1; 0 where
    neither has any."""
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts == SMOOTH).all(axis=0)] = 0.0
    return ratio


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """A model of ``label`` (0 or 1) from the rows of ``df`` that aren't held out.

    Rows without a label, or with a null label or key, teach nothing; rows repeated in key and text
    count each in the ratios and once in the fit. With no training rows, or rows of one class, scores
    are that class' smoothed share. Columns other than key, text and label are ignored.
    """
    known = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("__k"))).distinct()
    if known.count() <= FEW_LABELS:
        known = F.broadcast(known)  # FEW_LABELS rows at most
    rows = df.select(F.col(key).alias("__key"), "text").join(known, F.col("__key") == F.col("__k"))
    counts = rows.select("text", "label").mapInArrow(_counts, "feature int, bad bigint, good bigint").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    got = counts.toPandas()  # 2 ** BITS rows at most
    n = np.full((2, 1 << BITS), SMOOTH)
    n[0, got.feature.to_numpy()] += got.bad.to_numpy()
    n[1, got.feature.to_numpy()] += got.good.to_numpy()
    ratio = log_ratios(n)
    # rows are told apart by two hashes; the least are chosen from these alone, before any text moves
    hashed = rows.select("text", "label", F.xxhash64("__key").alias("hash"), F.xxhash64("__key", "text").alias("row"))
    first = hashed.select("hash", "row").distinct().orderBy("hash", "row").limit(FIT_ROWS)
    chosen = F.broadcast(first.select(F.col("row").alias("__c")))  # FIT_ROWS rows at most
    packed = hashed.join(chosen, F.col("row") == F.col("__c")).select("text", "label", "hash", "row").mapInArrow(_packed, "label int, features binary, size bigint, hash bigint, row bigint")
    packed = materialize(packed.dropDuplicates(["row", "label"]), "fit-rows")
    upto = Window.orderBy("hash", "row", "label").rowsBetween(Window.unboundedPreceding, 0)  # of FIT_ROWS rows, two labels each at most
    sample = packed.select("row", "label", "hash", "size").withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") <= FIT_FEATURES).select("row", "label")
    sample = packed.join(F.broadcast(sample), ["row", "label"]).select("label", "features").collect()
    found = [np.frombuffer(r.features, np.int32) for r in sample]
    y = np.array([1.0 if r.label else -1.0 for r in sample])
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(ratio, np.zeros_like(ratio), 0.0, 0.0, float(np.log(share / (1 - share))))
    order = sorted(range(len(found)), key=lambda i: (sample[i].features, y[i]))  # the same whatever order rows came in
    found, y = [found[i] for i in order], y[order]
    w, bias = dual_descent(found, ratio, y)
    margins = np.array([w[f] @ (ratio[f] / (np.sqrt(np.square(ratio[f]).sum()) or 1.0)) + bias for f in found])
    return Model(ratio, w * ratio, bias, *platt(margins, y))


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shared_features()
        for b in batches:
            scores = [model.score(features(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return score


def score(df: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(doc_id, score): 0 to 1, higher where label 1 is likelier. Null texts count as empty, and an
    empty text has the score of the curve's offset; very long ones are read whole. Every row has a
    score of its own, repeated ones too; an empty table gives an empty one."""
    return df.select(F.col(key).alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id bigint, score double")


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(documents, train(documents, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

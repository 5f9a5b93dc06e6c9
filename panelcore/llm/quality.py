"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams, of bytes (2 to 4 long, lower case) and of word
shapes (1 to 4 long; a shape says whether a word is upper case, capitalised, carries a
digit or a symbol, or repeats the word before it), hashed into 2^18 buckets. Each
indicator is scaled by its log-count ratio between the classes, each text to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent. Out-of-sample
margins of a part of the sample turn the margin into a probability.

Scale: the model is fitted on at most ``per_class`` labelled texts of each class (those
with the smallest id hashes; class rates come from all labelled training rows). Counts
are summed by Spark, at most 2^18 buckets x 2 classes reach the driver, and the descent
is one Python task that holds the sample's bucket numbers, not its texts. Scoring reads every whole text once, without a shuffle.

Nulls, ties and the rest: null and empty texts have no n-grams and get the score of the
bias; labels that repeat count once; with no labels all scores are 0.5, with labels of
one class only all scores are that class; rows that repeat repeat in the result; empty
tables give empty results; labels, lang, source and ids never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcore.llm.common import bounded_sample, id_fold, labelled, text_of
from panelcore.session import cut_lineage

BITS = 18
BUCKETS = 1 << BITS
BYTE_GRAMS = (2, 3, 4)
SHAPE_GRAMS = (1, 2, 3, 4)
PIECE = 1 << 20  # bytes hashed at a time


@dataclass(frozen=True)
class Model:
    weights: bytes  # float32 per bucket
    bias: float
    slope: float
    offset: float
    constant: float | None = None


def _hashes(codes: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Buckets of all n-grams of a byte array."""
    if len(codes) < n:
        return np.zeros(0, np.uint32)
    h = np.full(len(codes) - n + 1, 2166136261 ^ (salt * 2654435761 & 0xFFFFFFFF), np.uint32)
    for k in range(n):
        h = (h ^ codes[k:len(codes) - n + 1 + k]) * np.uint32(16777619)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return h >> np.uint32(32 - BITS)


def _shape(word: bytes, before: bytes) -> int:
    if word == before:
        return 82
    if word.isalpha() or not word.isascii():
        return 85 if word.isupper() and len(word) > 1 else 67 if word[:1].isupper() else 108
    tail = word[-2:]
    if tail.isalpha() or word[:-1].isalpha():
        return 112
    return 83 if not any(c > 127 or chr(c).isdigit() for c in tail) else 100


class Buckets:
    """Distinct buckets of a text; keeps one scratch array per task."""

    def __init__(self) -> None:
        self.at = np.zeros(BUCKETS, np.int64)

    def _distinct(self, h: np.ndarray) -> np.ndarray:
        order = np.arange(len(h))
        self.at[h] = order
        return h[self.at[h] == order]

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        shapes = np.array([_shape(w, p) for w, p in zip(words, [b"", *words])], np.uint32)
        found = [_hashes(shapes, n, 16 + n) for n in SHAPE_GRAMS]
        low = text.lower()
        over = max(BYTE_GRAMS) - 1
        for i in range(0, max(len(low) - over, 1), PIECE):  # pieces overlap: no gram is lost
            codes = np.frombuffer(low[i:i + PIECE + over], np.uint8).astype(np.uint32)
            part = np.concatenate([_hashes(codes, n, n) for n in BYTE_GRAMS])
            found.append(self._distinct(part))
        return self._distinct(np.concatenate(found))


def log_ratios(train: DataFrame, alpha: float = 1.0) -> np.ndarray:
    """Log-count ratio of every bucket over ``text, y`` (label 1 positive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, n = Buckets(), np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for text, y in zip(b["text"], b["y"].to_pylist()):
                n[y][buckets(text.as_py().encode())] += 1
        for y in (0, 1):
            at = np.flatnonzero(n[y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), y, np.int32)), pa.array(at.astype(np.int32)),
                 pa.array(n[y][at])], ["y", "bucket", "n"])

    sums = train.select("text", "y").mapInArrow(run, "y int, bucket int, n long").groupBy(
        "y", "bucket").agg(F.sum("n").alias("n")).toPandas()
    count = np.full((2, BUCKETS), alpha)
    count[sums["y"], sums["bucket"]] += sums["n"]
    p = count / count.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray,
            epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent of the hinge loss: weights per bucket and the bias."""
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    values = []
    for r in rows:
        v = ratio[r]
        norm = np.sqrt((v * v).sum())
        values.append(v / norm if norm else v)
    square = np.array([(v * v).sum() + 1.0 for v in values])  # 1 for the bias
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _margin(r: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> float:
    v = ratio[r]
    norm = np.sqrt((v * v).sum())
    return float(w[r] @ v / norm + bias) if norm else bias


def _platt(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    z = np.c_[m, np.ones(len(m))]
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        b = b + np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-3 * b)
    return float(max(b[0], 0.0)), float(b[1])


def fit(docs: DataFrame, ids: DataFrame, per_class: int = 3000, cost: float = 1.0) -> Model:
    """A model from the texts of ``docs`` and the labels ``doc_id, y``."""
    rates = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(rates) < 2:
        return Model(b"", 0.0, 0.0, 0.0, float(next(iter(rates), 0.5)))
    sample = bounded_sample(docs, ids, per_class)
    ratio = log_ratios(sample).astype(np.float32)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            lists = [buckets(t.as_py().encode()).astype(np.int32) for t in b["text"]]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["y"], pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "y", "x"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(d, y, np.asarray(x.values)) for b in batches
               for d, y, x in zip(b["doc_id"].to_pylist(), b["y"].to_pylist(), b["x"])]
        got.sort(key=lambda g: g[0])
        x = [g[2] for g in got]
        y = np.array([2 * g[1] - 1 for g in got], float)
        share = np.array([rates[1] if v > 0 else rates[0] for v in y], float)
        size = np.array([(y == v).sum() for v in y], float)
        c = cost * np.sqrt(len(y) / (2 * size))  # leans to the rarer class
        parts = 4
        margin = np.zeros(len(y))
        fold = np.arange(len(y)) % parts
        for k in range(parts):
            inside = np.flatnonzero(fold != k)
            w, bias = descend([x[i] for i in inside], y[inside], ratio, c[inside])
            for i in np.flatnonzero(fold == k):
                margin[i] = _margin(x[i], ratio, w, bias)
        weight = share / size
        slope, offset = _platt(margin, (y + 1) / 2, weight / weight.mean())
        w, bias = descend(x, y, ratio, c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([(w * ratio).astype(np.float32).tobytes()], pa.binary()), pa.array([bias]),
             pa.array([slope]), pa.array([offset])], ["w", "bias", "slope", "offset"])

    rows_in = cut_lineage(sample.mapInArrow(numbered, "doc_id long, y int, x array<int>"))
    best = rows_in.coalesce(1).mapInArrow(
        solve, "w binary, bias double, slope double, offset double").first()
    # Weights come times the ratio; a text's scale needs the ratios too.
    both = np.stack([np.frombuffer(bytes(best["w"]), np.float32), ratio])
    return Model(both.tobytes(), best["bias"], best["slope"], best["offset"])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        buckets = Buckets()
        if m.constant is None:
            w, ratio = np.frombuffer(m.weights, np.float32).reshape(2, BUCKETS)
            square = (ratio * ratio).astype(np.float64)
            w = w.astype(np.float64)
        for b in batches:
            p = np.full(b.num_rows, m.constant if m.constant is not None else 0.0)
            if m.constant is None:
                for i, t in enumerate(b["text"]):
                    r = buckets(t.as_py().encode())
                    norm = np.sqrt(square[r].sum())
                    margin = w[r].sum() / norm + m.bias if norm else m.bias
                    p[i] = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = 0.7,
           per_class: int = 3000) -> DataFrame:
    """``doc_id, held_out, score, predicted``; rows of fold ``held`` teach nothing."""
    train = docs.where(id_fold(F.col("doc_id"), folds) != held)
    model = fit(train, labelled(train, labels, "quality"), per_class)
    return scores(docs, model).select(
        "doc_id", (id_fold(F.col("doc_id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"))

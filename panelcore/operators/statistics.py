"""Mergeable second moments: one pass over the samples serves every expanding fold.

Rolling folds only ever add periods, so a sample belongs to the *segment* of the first
fold that fits on it, and the statistics of fold ``k`` are those of segments 0 to ``k``
merged. A segment is summed up as (count, mean, centred products); two such summaries
merge exactly and without cancellation, whatever the level of the features. Tasks emit
their summary in blocks of rows of the product matrix, blocks are merged by key, and the
driver receives folds x features^2 numbers, however many samples there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "segment int, block int, n double, mean binary, products binary"
#: Rows of the product matrix that travel as one value.
BLOCK = 256


@dataclass
class Moments:
    """Count, mean and centred products of a set of vectors."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        d = x - mean
        return Moments(float(len(x)), mean, d.T @ d)

    def merged(self, other: Moments, rows: slice = slice(None)) -> Moments:
        """Both sets together; ``products`` may hold only ``rows`` of the matrix."""
        n = self.n + other.n
        d = other.mean - self.mean
        shift = np.outer(d[rows], d) * (self.n * other.n / n)
        return Moments(n, self.mean + d * (other.n / n), self.products + other.products + shift)


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    v = b.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Moments] = {}
    for b in batches:
        if not b.num_rows:
            continue
        x, segment = _vectors(b), b.column("segment").to_numpy()
        for s in np.unique(segment).tolist():
            new = Moments.of(x[segment == s])
            found[s] = found[s].merged(new) if s in found else new
    for s, m in found.items():
        for k, a in enumerate(range(0, len(m.mean), BLOCK)):
            yield _row(s, k, Moments(m.n, m.mean, m.products[a:a + BLOCK]))


def _row(segment: int, block: int, m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([segment], pa.int32()), pa.array([block], pa.int32()), pa.array([m.n]),
         pa.array([m.mean.tobytes()], pa.binary()), pa.array([m.products.tobytes()], pa.binary())],
        ["segment", "block", "n", "mean", "products"])


def _read(row: dict) -> Moments:
    mean = np.frombuffer(row["mean"])
    return Moments(row["n"], mean, np.frombuffer(row["products"]).reshape(-1, len(mean)))


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, None
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            at, m = (row["segment"], row["block"]), _read(row)
            if at == key:
                held = held.merged(m, slice(at[1] * BLOCK, (at[1] + 1) * BLOCK))
                continue
            if held is not None:
                yield _row(*key, held)
            key, held = at, m
    if held is not None:
        yield _row(*key, held)


def segment_moments(rows: DataFrame) -> dict[int, Moments]:
    """Moments of ``v`` (array<double>) per ``segment`` (int), from one pass."""
    keys = ["segment", "block"]
    parts = rows.select("segment", "v").mapInArrow(_summaries, PARTS)
    merged = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge_blocks, PARTS)
    found: dict[int, list] = {}
    for row in merged.toArrow().to_pylist():
        found.setdefault(row["segment"], []).append((row["block"], _read(row)))
    out = {}
    for s, blocks in found.items():
        ordered = [m for _, m in sorted(blocks, key=lambda x: x[0])]
        out[s] = Moments(ordered[0].n, ordered[0].mean, np.vstack([m.products for m in ordered]))
    return out


def fold_moments(segments: dict[int, Moments], numbers: list[int]) -> dict[int, Moments]:
    """Moments of every expanding fold: running merges of the segments."""
    out, total = {}, None
    for k in sorted(numbers):
        new = segments.get(k)
        if new is not None:
            total = new if total is None else total.merged(new)
        if total is not None:
            out[k] = total
    return out


def pooled_scale(mean: np.ndarray, variance: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale per feature over samples and steps, from those of the flat view.

    Population deviation; a constant feature keeps scale 1.
    """
    m, v = mean.reshape(steps, -1), variance.reshape(steps, -1)
    centre = m.mean(axis=0)
    spread = v.mean(axis=0) + ((m - centre) ** 2).mean(axis=0)
    constant = (v <= 0).all(axis=0) & (np.ptp(m, axis=0) <= 1e-12 * np.maximum(1.0, np.abs(centre)))
    return centre, np.where(constant, 1.0, np.sqrt(np.where(constant, 1.0, spread)))


@dataclass
class RidgePath:
    """One fold's ridge solutions for every alpha, in the eigenbasis of its products."""

    moments: Moments
    scale: np.ndarray
    eigen: np.ndarray
    basis: np.ndarray
    load: np.ndarray

    @staticmethod
    def of(m: Moments, steps: int) -> RidgePath:
        """The last coordinate of the moments is the label."""
        x = m.products[:-1, :-1]
        _, sd = pooled_scale(m.mean[:-1], np.diag(x) / m.n, steps)
        d = 1.0 / np.tile(sd, steps)
        eigen, vectors = np.linalg.eigh(x * d[:, None] * d)
        basis = d[:, None] * vectors  # raw, centred features to the eigenbasis
        return RidgePath(m, sd, np.maximum(eigen, 0.0), basis, basis.T @ m.products[:-1, -1])

    def solution(self, alpha: float) -> tuple[np.ndarray, float]:
        """Coefficients of the raw flat view, and the intercept."""
        coef = self.basis @ (self.load / (self.eigen + alpha))
        return coef, float(self.moments.mean[-1] - self.moments.mean[:-1] @ coef)


def leave_one_out(rows: DataFrame, paths: dict[int, RidgePath], alphas: tuple[float, ...]
                  ) -> dict[int, dict[float, float]]:
    """Sum of squared leave-one-out residuals per fold and alpha: one pass for all folds.

    A row counts for every fold from its segment on. Only the folds' eigenbases are
    broadcast: folds x features^2 numbers.
    """
    sent = rows.sparkSession.sparkContext.broadcast(paths)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(k, a): 0.0 for k in sent.value for a in alphas}
        for b in batches:
            if not b.num_rows:
                continue
            v, segment = _vectors(b), b.column("segment").to_numpy()
            for k, path in sent.value.items():
                c = v[segment <= k] - path.moments.mean
                z = c[:, :-1] @ path.basis
                for a in alphas:
                    inverse = 1.0 / (path.eigen + a)
                    hat = 1.0 / path.moments.n + (z * z) @ inverse
                    error = (c[:, -1] - z @ (inverse * path.load)) / (1.0 - hat)
                    sums[k, a] += float(error @ error)
        k, a = zip(*sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(a), pa.array(list(sums.values()))],
            ["fold", "alpha", "sse"])

    total = rows.select("segment", "v").mapInArrow(partial, "fold int, alpha double, sse double")
    out: dict[int, dict[float, float]] = {}
    for r in total.groupBy("fold", "alpha").agg(F.sum("sse").alias("sse")).collect():
        out.setdefault(r["fold"], {})[r["alpha"]] = r["sse"]
    return out

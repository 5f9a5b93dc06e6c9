"""Gradient-boosted trees of all folds side by side, on bins that are cut once.

Features are cut into at most ``BINS`` quantile bins, from a bounded sample, and packed
once as one byte per cell. All folds then grow together: a level of a round is one job
that sums residuals by (fold, node, feature, bin) over the packed blocks, whichever folds
a row belongs to; the sums of a fold meet in one task, which reads its best splits off
them. So the number of jobs is rounds times depth, however many folds there are, what
travels between tasks is folds x nodes x features x bins from each of them, and the driver
gets one split per fold and node, however many rows and features there are. Squared loss, full weight for the first tree and the
learning rate for every other one.

A row's residuals follow from its last written state and the few trees since; every
``WRITE`` rounds the state is written again, so neither plans nor recomputation grow with
the rounds, and a lost executor repeats one short stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from panelcore.session import cut_lineage

BINS = 32
#: Rows whose values decide where bins are cut.
SAMPLE = 10_000
ROWS = 4096
WRITE = 25
#: Histograms of blocks in more partitions than this one need an exchange to be summed.
DIRECT = 1
PACKED = "n int, segment binary, bins binary, y binary, state binary"


@dataclass
class Trees:
    """One tree per fold, as complete binary trees of one depth.

    A node without a split has feature -1 and sends every row to the left.
    """

    feature: np.ndarray  # (folds, inner nodes)
    cut: np.ndarray      # (folds, inner nodes): the last bin that goes left
    value: np.ndarray    # (folds, leaves), weight included

    def leaf(self, bins: np.ndarray, fold: int, depth: int) -> np.ndarray:
        """Number of the node, within its level, that each row reaches after ``depth``."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for level in range(depth):
            at = 2**level - 1 + node
            f = self.feature[fold, at]
            node = 2 * node + ((f >= 0) & (bins[rows, f] > self.cut[fold, at]))
        return node


def cuts_of(sample: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Ascending upper ends of all bins but the last, per feature."""
    out = []
    for x in sample.T:
        values = np.unique(x)
        if len(values) > bins:
            values = np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))
            out.append(values)
        else:
            out.append((values[:-1] + values[1:]) / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


def _packed_blocks(rows: DataFrame, cuts: list[np.ndarray], folds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                part = b.slice(a, ROWS)
                n = part.num_rows
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                cells = [part.column("segment").to_numpy().astype(np.int32), binned(v[:, :-1], cuts),
                         v[:, -1].copy(), np.zeros((n, folds))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
                    ["n", "segment", "bins", "y", "state"])

    return rows.mapInArrow(run, PACKED)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            n = b.column("n")[i].as_py()
            raw = [b.column(c)[i].as_py() for c in ("segment", "bins", "y", "state")]
            yield (np.frombuffer(raw[0], np.int32), np.frombuffer(raw[1], np.uint8).reshape(n, -1),
                   np.frombuffer(raw[2]), np.frombuffer(raw[3]).reshape(n, -1))


def _advanced(state: np.ndarray, bins: np.ndarray, trees: list[Trees], depth: int) -> np.ndarray:
    out = state.copy()
    for t in trees:
        for k in range(out.shape[1]):
            out[:, k] += t.value[k, t.leaf(bins, k, depth)]
    return out


def _level(blocks: DataFrame, since: list[Trees], growing: Trees, level: int, depth: int,
           folds: int, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_split` of one level of all folds, read off the histograms in the tasks."""
    nodes = 2**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((folds, nodes * features * BINS, 2))
        for segment, bins, y, state in _unpacked(batches):
            now = _advanced(state, bins, since, depth)
            for k in range(folds):
                use = segment <= k
                own = bins[use]
                node = growing.leaf(own, k, level)
                at = ((node[:, None] * features + np.arange(features)) * BINS + own).ravel()
                r = np.repeat((y - now[:, k])[use], features)
                out[k, :, 0] += np.bincount(at, r, minlength=out.shape[1])
                out[k, :, 1] += np.bincount(at, minlength=out.shape[1])
        task = TaskContext.get().partitionId()
        for k in range(folds):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([task], pa.int32()),
                 pa.array([out[k].tobytes()], pa.binary())], ["k", "task", "h"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, h in zip(b.column("k").to_pylist(), b.column("h")):
                part = np.frombuffer(h.as_buffer())
                found[k] = found[k] + part if k in found else part
        for k, h in found.items():
            split = np.concatenate(_split(h.reshape(1, nodes, features, BINS, 2))).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([split.tobytes()], pa.binary())], ["k", "s"])

    parts = blocks.mapInArrow(run, "k int, task int, h binary")
    if blocks.rdd.getNumPartitions() > DIRECT:  # summed in the order of tasks, so reruns agree
        parts = parts.repartition(folds, "k").sortWithinPartitions("k", "task")
    out = np.zeros((4, folds, nodes))
    out[0] = -1
    for r in parts.mapInArrow(best, "k int, s binary").collect():
        out[:, r["k"]] = np.frombuffer(r["s"]).reshape(4, nodes)
    return out[0].astype(np.int64), out[1].astype(np.int64), out[2], out[3]


def _split(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best (feature, cut) of every fold and node, and the means left and right of it."""
    folds, nodes = h.shape[:2]
    whole = h[:, :, 0].sum(axis=2)  # every feature sums up to the node
    left = np.cumsum(h, axis=3)[..., :-1, :]
    right = whole[:, :, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1]
        base = np.where(whole[..., 1] > 0, whole[..., 0] ** 2 / whole[..., 1], 0.0)
        mean = np.where(whole[..., 1] > 0, whole[..., 0] / whole[..., 1], 0.0)
    gain = np.where((left[..., 1] > 0) & (right[..., 1] > 0), gain, -np.inf)
    flat = gain.reshape(folds, nodes, -1)
    at = flat.argmax(axis=2)
    best = np.take_along_axis(flat, at[..., None], 2)[..., 0]
    feature, cut = np.divmod(at, gain.shape[3])
    worth = best > base + 1e-12 * np.maximum(1.0, base)
    pick = np.ix_(range(folds), range(nodes))
    sides = []
    for side in (left, right):
        s = side[pick[0], pick[1], feature, cut]
        sides.append(np.where(worth, np.divide(s[..., 0], np.maximum(s[..., 1], 1.0)), mean))
    return np.where(worth, feature, -1), np.where(worth, cut, 0), sides[0], sides[1]


def boosted(rows: DataFrame, folds: int, rounds: int, depth: int, rate: float
            ) -> tuple[list[np.ndarray], list[Trees]]:
    """(bin cuts, trees) over ``segment, v`` with the label as the last coordinate; a row
    counts for all folds from its segment on."""
    sample = rows.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    x = sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1)[:, :-1]
    cuts, features = cuts_of(x), x.shape[1]
    blocks = _packed_blocks(rows, cuts, folds).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[Trees] = []
    since: list[Trees] = []
    try:
        for n in range(rounds):
            inner = 2**depth - 1
            t = Trees(np.full((folds, inner), -1), np.zeros((folds, inner), np.int64),
                      np.zeros((folds, inner + 1)))
            for level in range(depth):
                at = slice(2**level - 1, 2**(level + 1) - 1)
                t.feature[:, at], t.cut[:, at], left, right = _level(
                    blocks, since, t, level, depth, folds, features)
            t.value = np.stack([left, right], axis=2).reshape(folds, -1) * (rate if n else 1.0)
            trees.append(t)
            since.append(t)
            if len(since) == WRITE:
                blocks, since = _written(blocks, since, depth), []
    finally:
        blocks.unpersist()
    return cuts, trees


def _written(blocks: DataFrame, since: list[Trees], depth: int) -> DataFrame:
    """The blocks with their state brought up to date, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states = [_advanced(state, bins, since, depth).tobytes()
                      for _, bins, _, state in _unpacked(iter([b]))]
            yield b.set_column(4, "state", pa.array(states, pa.binary()))

    new = cut_lineage(blocks.mapInArrow(run, PACKED)).persist(StorageLevel.MEMORY_AND_DISK)
    blocks.unpersist()
    return new


def predicted(rows: DataFrame, cuts: list[np.ndarray], trees: list[Trees], depth: int) -> DataFrame:
    """``rows`` (with ``fold`` and ``seq``) plus ``prediction`` by their fold's trees."""
    sent = rows.sparkSession.sparkContext.broadcast((cuts, trees))
    schema = rows.withColumn("prediction", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, trees = sent.value
        for b in batches:
            fold = b.column("fold").to_numpy()
            flat = b.column("seq").flatten().flatten().to_numpy(zero_copy_only=False)
            bins = binned(flat.reshape(b.num_rows, -1), cuts)
            out = np.zeros(b.num_rows)
            for k in np.unique(fold).tolist():
                use = fold == k
                own = bins[use]
                out[use] = sum(t.value[k, t.leaf(own, k, depth)] for t in trees)
            yield b.append_column("prediction", pa.array(out))

    return rows.mapInArrow(run, schema)

"""Exact Shapley values of stored tree ensembles, without permutations.

A leaf is reached when every column on its path keeps all its conditions. Replace the
columns outside a coalition by a background row: the leaf's game then depends on two bit
patterns only, which columns the row satisfies and which the background row satisfies.
Columns that both satisfy do not matter, one that neither satisfies rules the leaf out,
and for the others the Shapley value is a ratio of factorials. So one pass over the
background counts how often each leaf sees each pattern, a table per leaf turns a row's
pattern into the values of its columns, averaged over *all* background rows, and one pass
over the rows reads that table. Work is leaves x rows, linear in both tables; what is
broadcast is bounded by the size of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcore.operators.features import FeatureSpec
from panelcore.params import ParamError

KEYS = ["entity", "period"]
#: Cells of one block of rows by leaves by conditions.
CELLS = 1 << 22


@dataclass
class Leaves:
    """All leaves of an ensemble. Conditions and columns are padded per leaf.

    ``low < x[feature] <= high`` are the conditions, ``slot`` the column on the path that
    each belongs to, ``column`` the number of the column behind each slot (-1: none).
    """

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    slot: np.ndarray
    column: np.ndarray

    @property
    def width(self) -> int:
        return self.column.shape[1]

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves): bit ``s`` is set if all conditions of slot ``s`` hold."""
        at = x[:, self.feature]
        holds = (at > self.low) & (at <= self.high)
        out = np.zeros((len(x), len(self.value)), np.int64)
        for s in range(self.width):
            out |= np.where(self.slot == s, holds, True).all(axis=2).astype(np.int64) << s
        return out

    def blocks(self, rows: int) -> Iterator[slice]:
        step = max(1, CELLS // max(1, self.feature.size))
        return (slice(a, a + step) for a in range(0, rows, step))


def stored_leaves(spark: SparkSession, path: str, spec: FeatureSpec) -> Leaves:
    """Leaves of the boosted trees in the last stage of a stored pipeline.

    The driver reads the nodes of the model, never rows of a table.
    """
    nodes = spark.read.parquet(f"{path}/stages/*/data").toDF("treeID", "nodeData")
    about = spark.read.parquet(f"{path}/stages/*/treesMetadata").toDF("treeID", "metadata", "weight")
    weights = {r["treeID"]: r["weight"] for r in about.collect()}
    trees: dict[int, dict[int, dict]] = {}
    for r in nodes.select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    found: list[tuple[float, dict]] = []
    for tree, by_id in trees.items():
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            at, held = stack.pop()
            node = by_id[at]
            if node["leftChild"] < 0:
                found.append((node["prediction"] * weights[tree], held))
                continue
            split = node["split"]
            if split["numCategories"] != -1:
                raise ParamError("only continuous splits can be explained")
            f, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high = held.get(f, (-np.inf, np.inf))
            stack.append((node["leftChild"], {**held, f: (low, min(high, cut))}))
            stack.append((node["rightChild"], {**held, f: (max(low, cut), high)}))
    return _arrays(found, len(spec.columns))


def _arrays(found: list[tuple[float, dict]], n_columns: int) -> Leaves:
    deep = max([1, *(len(h) for _, h in found)])
    shape = (len(found), deep)
    feature, slot = np.zeros(shape, np.int64), np.full(shape, -1)
    low, high = np.full(shape, -np.inf), np.full(shape, np.inf)
    column = np.full(shape, -1)
    for i, (_, held) in enumerate(found):
        slots: dict[int, int] = {}
        for k, (f, (a, z)) in enumerate(held.items()):
            s = slots.setdefault(f % n_columns, len(slots))
            feature[i, k], low[i, k], high[i, k], slot[i, k] = f, a, z, s
            column[i, s] = f % n_columns
    used = max(1, int((column >= 0).sum(axis=1).max(initial=0)))
    return Leaves(np.array([v for v, _ in found]), feature, low, high, slot, column[:, :used])


def _flat(b: pa.RecordBatch) -> np.ndarray:
    v = b.column("x")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def pattern_shares(background: DataFrame, leaves: Leaves) -> np.ndarray:
    """(leaves, patterns): share of the background rows with each pattern, from one pass."""
    size = 1 << leaves.width
    offset = np.arange(len(leaves.value)) * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(leaves.value) * size, np.int64)
        for b in batches:
            x = _flat(b)
            for part in leaves.blocks(len(x)):
                seen = leaves.patterns(x[part]) + offset
                counts += np.bincount(seen.ravel(), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    out = np.zeros(len(leaves.value) * size)
    flat = background.select(F.flatten("seq").alias("x")).mapInArrow(run, "at long, n long")
    for r in flat.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    out = out.reshape(-1, size)
    total = out[0].sum() if len(out) else 0
    if not total:
        raise ParamError("the background is empty")
    return out / total


def shapley_weights(width: int) -> np.ndarray:
    """(row pattern, background pattern, slot): value of a slot in a leaf of value 1."""
    size = 1 << width
    out = np.zeros((size, size, width))
    for a in range(size):
        for c in range(size):
            if (a | c) != size - 1:
                continue  # some column is satisfied by neither
            ours, theirs = a & ~c, c & ~a
            p, q = ours.bit_count(), theirs.bit_count()
            for s in range(width):
                if ours >> s & 1:
                    out[a, c, s] = factorial(p - 1) * factorial(q) / factorial(p + q)
                elif theirs >> s & 1:
                    out[a, c, s] = -factorial(p) * factorial(q - 1) / factorial(p + q)
    return out


def explain_trees(samples: DataFrame, spec: FeatureSpec, leaves: Leaves, background: DataFrame
                  ) -> DataFrame:
    """``entity, period, column, value``: exact values over the whole background.

    Empty slots are always satisfied by both sides, so they never carry a value.
    """
    shares = pattern_shares(background, leaves)
    table = np.einsum("lc,acs->las", shares, shapley_weights(leaves.width))
    table *= leaves.value[:, None, None]
    n_columns, names = len(spec.columns), spec.columns
    where = np.zeros((leaves.column.size, n_columns))
    slot = np.flatnonzero(leaves.column.ravel() >= 0)
    where[slot, leaves.column.ravel()[slot]] = 1.0
    sent = samples.sparkSession.sparkContext.broadcast((leaves, table, where))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, table, where = sent.value
        each = np.arange(len(leaves.value))
        for b in batches:
            x = _flat(b)
            values = np.empty((len(x), n_columns))
            for part in leaves.blocks(len(x)):
                seen = leaves.patterns(x[part])
                values[part] = table[each, seen].reshape(len(seen), -1) @ where
            rows = pa.array(np.repeat(np.arange(len(x)), n_columns))
            yield pa.RecordBatch.from_arrays(
                [b.column("entity").take(rows), b.column("period").take(rows),
                 pa.array(names * len(x), pa.string()), pa.array(values.ravel())],
                [*KEYS, "column", "value"])

    kinds = dict(samples.dtypes)
    schema = f"entity {kinds['entity']}, period {kinds['period']}, column string, value double"
    return samples.select(*KEYS, F.flatten("seq").alias("x")).mapInArrow(run, schema)

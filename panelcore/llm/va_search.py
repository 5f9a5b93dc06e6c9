"""Exact top-k search by inner product over a vector-approximation file.

The file holds, for every distinct vector, one small cell number per component. Cell
limits come from quantiles of a bounded sample (``sample`` vectors, those with the
smallest digests); the least and the largest value that really lie in each cell come from
all vectors. From them a vector's inner product with a query is known up to an interval
without reading the vector. The search reads cells twice and vectors once:

1. scan of the cells: each task keeps the ``k + 1`` largest lower limits of every query;
   the (k+1)-th over all tasks is a score that the answer reaches in any case
2. scan of the cells beside the vectors: what cannot reach that score is passed over; the
   rest is read in the order of its upper limit, until the task's own (k+1)-th exact
   score beats every limit that is left

Scale: equal vectors are one entry with their k + 1 smallest ids, so a vector that a third
of all rows share costs one entry, and a window group limit keeps it small before the
shuffle. Queries pass through in panels of at most ``PANEL`` components (8 MB), the only
thing that is broadcast; every task holds one block of entries and one panel's best
scores. Queries with one vector are searched once. What tasks return is at most
``k + 1`` rows a query, and only those above the first scan's score.

Nulls, ties and the rest: vectors that are null or hold a null or non-finite component
take no part; a component missing in a shorter vector counts as zero; ties go to the
smaller id, null ids last; a null id is no query; rows that repeat are candidates and
queries each for themselves; scaled components and scores beyond a long saturate; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.functions.ranks import global_row_number
from panelcore.session import cut_lineage, scratch_path

#: Components of queries that are searched, and broadcast, at once.
PANEL = 1 << 20
#: Products of one block of entries with one panel.
BLOCK = 1 << 21
HIT = "qn long, score long, vec_id long, own boolean"


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, key, v``: floor(scale * x) of every usable vector; equal vectors share a key."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))
    rows = vectors.where(x.isNotNull() & ~odd).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    key = F.unhex(F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    return rows.select("vec_id", key.alias("key"), "v")


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """``key, v, ids``: each distinct vector with its ``keep`` smallest ids."""
    w = W.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    ids = F.sort_array(F.collect_list(F.struct("_r", "vec_id")))
    return few.groupBy("key").agg(F.first("v").alias("v"), ids["vec_id"].alias("ids"))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Rows of one length; missing components are zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    if len(flat) == n * d:
        return flat.reshape(n, d)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((n, d), np.int64)
    out[np.arange(d) < size[:, None]] = flat
    return out


def cell_limits(sample: np.ndarray, cells: int) -> np.ndarray:
    """(components, cells - 1): inner limits of the cells, quantiles of the sample."""
    at = np.arange(1, cells) / cells
    return np.quantile(sample, at, axis=0, method="higher").T.astype(np.int64)


def with_cells(table: DataFrame, limits: np.ndarray) -> DataFrame:
    """The entries with ``code``: one byte per component, the number of its cell."""
    d = len(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), d)
            code = np.empty(v.shape, np.uint8)
            for j in range(d):
                code[:, j] = np.searchsorted(limits[j], v[:, j], side="right")
            yield b.append_column("code", pa.array([c.tobytes() for c in code], pa.binary()))

    return table.mapInArrow(run, "key binary, v array<bigint>, ids array<bigint>, code binary")


def cell_ranges(file: DataFrame, d: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each (component, cell) over all entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full((d, cells), np.iinfo(np.int64).max)
        high = np.full((d, cells), np.iinfo(np.int64).min)
        for b in batches:
            v, code = _matrix(b.column("v"), d), _codes(b, d)
            for j in range(d):
                np.minimum.at(low[j], code[:, j], v[:, j])
                np.maximum.at(high[j], code[:, j], v[:, j])
        j, c = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays(
            [pa.array(j), pa.array(c), pa.array(low[j, c]), pa.array(high[j, c])],
            ["j", "c", "low", "high"])

    seen = file.select("v", "code").mapInArrow(run, "j long, c long, low long, high long")
    low, high = np.zeros((d, cells)), np.zeros((d, cells))
    for r in seen.groupBy("j", "c").agg(F.min("low"), F.max("high")).collect():
        low[r[0], r[1]], high[r[0], r[1]] = r[2], r[3]
    return low, high


def _codes(b: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, d)


class Panel:
    """A bounded block of queries with what bounds their scores from cell numbers."""

    def __init__(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.v, self.size = vectors, len(vectors)
        self.q = vectors.astype(np.float64)
        self.mid, self.half = (low + high) / 2, (high - low) / 2
        most = np.maximum(np.abs(low), np.abs(high)).max(axis=1)
        self.slack = (np.abs(self.q) @ most) * len(low) * 2.0**-50
        reach = float(np.abs(self.q).max(initial=0)) * float(most.max(initial=0)) * len(low)
        self.wide = reach >= 2.0**62

    def blocks(self, rows: int) -> Iterator[slice]:
        step = max(1, BLOCK // max(self.size, self.q.shape[1]))
        return (slice(a, min(a + step, rows)) for a in range(0, rows, step))

    def bounds(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, entries): what the inner products cannot fall below or exceed."""
        j = np.arange(code.shape[1])
        middle = self.q @ self.mid[j, code].T
        spread = np.abs(self.q) @ self.half[j, code].T + self.slack[:, None]
        return middle - spread, middle + spread

    def exact(self, i: int, v: np.ndarray) -> list[int]:
        if self.wide:
            last = 2**63 - 1
            return [max(-last - 1, min(last, int(s)))
                    for s in v.astype(object) @ self.v[i].astype(object)]
        return (v @ self.v[i]).tolist()


def _lower_limits(panel: Panel, d: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((panel.size, keep), -np.inf)
        for b in batches:
            code = _codes(b, d)
            for part in panel.blocks(len(code)):
                low, _ = panel.bounds(code[part])
                rows = np.flatnonzero(low.max(axis=1) > best[:, 0])
                both = np.hstack([best[rows], low[rows]])
                best[rows] = np.sort(np.partition(both, -keep, axis=1)[:, -keep:], axis=1)
        i, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[i, j])], ["i", "low"])

    return run


def _read_in_order(panel: Panel, d: int, keep: int, numbers: np.ndarray, own: list[bytes],
                   reached: np.ndarray, chunk: int = 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = reached.copy()  # a score that each query's answer reaches
        best: dict[int, list[tuple]] = {}
        for b in batches:
            code, v = _codes(b, d), _matrix(b.column("v"), d)
            for part in panel.blocks(len(code)):
                _, high = panel.bounds(code[part])
                for i in np.flatnonzero((high >= floor[:, None]).any(axis=1)).tolist():
                    order = np.flatnonzero(high[i] >= floor[i])
                    order = order[np.argsort(-high[i, order], kind="stable")]
                    for a in range(0, len(order), chunk):
                        if high[i, order[a]] < floor[i]:
                            break  # certain: nothing that is left can reach the k-th
                        at = order[a:a + chunk] + part.start
                        found = best.get(i, [])
                        for r, s in zip(at.tolist(), panel.exact(i, v[at])):
                            mine = b.column("key")[r].as_py() == own[i]
                            found += [(-s, x is None, x or 0, mine)
                                      for x in b.column("ids")[r].as_py()]
                        best[i] = found = nsmallest(keep, found)
                        if len(found) == keep:
                            floor[i] = max(floor[i], -found[-1][0])
        hits = [(numbers[i], -s, None if null else x, mine)
                for i, found in best.items() for s, null, x, mine in found if -s >= floor[i]]
        columns = list(zip(*hits)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.bool_(),))],
            ["qn", "score", "vec_id", "own"])

    return run


def best_hits(file: DataFrame, asked: DataFrame, keep: int, low: np.ndarray,
              high: np.ndarray) -> DataFrame:
    """``qn, score, vec_id, own``: the ``keep`` best rows of every query vector.

    ``asked`` holds ``qn`` (from 1), ``key`` and ``v``; one panel after another is
    searched, and each panel's answers are written before the next one starts.
    """
    spark, d = file.sparkSession, len(low)
    step = max(1, PANEL // d)
    total = asked.agg(F.max("qn")).first()[0] or 0
    out = spark.createDataFrame([], HIT)
    first = W.partitionBy("i").orderBy(F.desc("low"))
    top = W.partitionBy("qn").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    for a in range(1, total + 1, step):
        part = asked.where(F.col("qn").between(a, a + step - 1)).toArrow().combine_chunks()
        panel = Panel(_matrix(part["v"].combine_chunks(), d), low, high)
        limits = file.select("code").mapInArrow(_lower_limits(panel, d, keep), "i long, low double")
        kth = limits.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep)
        kth = kth.groupBy("i").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n"))
        reached = np.full(panel.size, -np.inf)
        for r in kth.where(F.col("n") == keep).collect():
            reached[r["i"]] = r["low"]
        numbers, own = part["qn"].to_numpy(), part["key"].to_pylist()
        hits = file.mapInArrow(_read_in_order(panel, d, keep, numbers, own, reached), HIT)
        hits = hits.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= keep)
        out = out.union(cut_lineage(hits.drop("_r")))
    return out


def top_k(vectors: DataFrame, asked: Column, k: int = 5, scale: int = 256, bits: int = 6,
          sample: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: of every row where ``asked`` holds, the ``k``
    other rows with the largest inner product."""
    spark, keep, cells = vectors.sparkSession, k + 1, 1 << min(bits, 8)
    rows = scaled(vectors, scale)
    queries = rows.where(asked & F.col("vec_id").isNotNull()).select("vec_id", "key")
    table = cut_lineage(entries(rows, keep))  # a row's own place is one of k + 1
    d = max(1, table.agg(F.max(F.size("v"))).first()[0] or 0)
    fit = table.orderBy("key").limit(sample).select("v").toArrow()["v"].combine_chunks()
    if not len(fit):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    path = scratch_path(spark, "cells")
    with_cells(table, cell_limits(_matrix(fit, d), cells)).write.parquet(path)
    file = spark.read.parquet(path)
    low, high = cell_ranges(file, d, cells)

    once = table.join(queries.select("key").distinct(), "key", "left_semi").select("key", "v")
    numbered = cut_lineage(global_row_number(once, ["key"], "qn"))
    hits = best_hits(file, numbered, keep, low, high)
    one = F.struct(
        F.bitwise_not("score").alias("order"), F.col("vec_id").isNull().alias("no_id"),
        "vec_id", "own", "score")
    lists = hits.groupBy("qn").agg(F.sort_array(F.collect_list(one)).alias("all"))
    lists = lists.join(numbered.select("qn", "key"), "qn").drop("qn")
    # Of what was found for the vector, a query leaves out its own row.
    me = F.array_position(
        F.transform("all", lambda x: x["own"] & x["vec_id"].eqNullSafe(F.col("me"))), True)
    rest = F.filter("all", lambda x, at: at + 1 != F.col("_at"))
    return (
        queries.withColumnRenamed("vec_id", "me").join(lists, "key")
        .withColumn("_at", me)
        .select(F.col("me").alias("query_id"), F.posexplode(F.slice(rest, 1, k)).alias("rank", "x"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
    )

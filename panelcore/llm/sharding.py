"""Sharding by longest-processing-time scheduling.

Rows that must stay together form a group; groups, largest first, go to the shard with
the least load, which a heap holds. Groups are as many as there are texts, so the
heap gets a bounded list of items: every group of at least 1/``per_shard`` of a
shard's fair load is an item of its own (there are at most ``shards * per_shard``
of them), and all smaller groups are collected into ``shards * per_shard`` lots by the
hash of the group. Items are far smaller than a shard, so loads come out near equal.

Scale: sizes are summed per group with map-side combine, so a group that holds a third
of all rows is one row. The item list and the map from item to shard have a bound that
depends on the parameters only; the map is broadcast. Slots are running numbers inside
a shard: rows are hashed into cells of about ``cell_rows`` rows, cells get offsets from
a running sum, and rows are numbered inside their cell, so no shard is ever one task.

Nulls, ties and the rest: null and empty texts are one group of 8 bytes a row; groups of
equal size go in the order of their digest, equal loads to the lowest shard number;
rows that repeat an id share a cell and are numbered in any order; an empty table gives
an empty result; columns that clash with results are replaced.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.llm.common import text_of
from panelcore.session import cut_lineage

ROW_BYTES = 8


def lpt(items: list[tuple[str, int]], shards: int) -> list[tuple[str, int]]:
    """(item, shard): largest item first, to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out.append((name, shard))
        heapq.heappush(heap, (load + size, shard))
    return out


def assign(rows: DataFrame, shards: int, per_shard: int) -> DataFrame:
    """Adds ``shard`` to rows that have ``grp`` (hex digest of the group) and ``size``."""
    spark = rows.sparkSession
    groups = rows.groupBy("grp").agg(F.sum("size").alias("load"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bound = max(1.0, total / (shards * per_shard))
    # At most shards * per_shard groups reach the bound, whatever the data.
    heavy = cut_lineage(groups.where(F.col("load") >= bound))
    lot = F.concat(F.lit("lot"), F.pmod(F.xxhash64("grp"), F.lit(shards * per_shard)))
    light = groups.join(F.broadcast(heavy.select("grp")), "grp", "left_anti").groupBy(
        lot.alias("item")
    ).agg(F.sum("load").alias("load"))
    items = heavy.select(F.col("grp").alias("item"), "load").union(light).collect()
    where = spark.createDataFrame(
        lpt([(r["item"], r["load"]) for r in items], shards), "item string, shard int"
    )
    own = heavy.select("grp", F.col("grp").alias("_own"))
    return rows.join(F.broadcast(own), "grp", "left").withColumn(
        "item", F.coalesce("_own", lot)
    ).join(F.broadcast(where), "item").drop("_own", "item")


def number_slots(rows: DataFrame, order: list[str], n: int, cell_rows: int = 100_000) -> DataFrame:
    """Adds ``slot``: 0, 1, ... without gaps inside each ``shard``, over ``n`` rows."""
    cells = max(1, math.ceil(n / cell_rows))
    celled = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    per = celled.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offset = per.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("shard", "_cell").orderBy(*order)
    return celled.withColumn("_nth", F.row_number().over(inside)).join(
        offset, ["shard", "_cell"]
    ).withColumn("slot", (F.col("_off") + F.col("_nth") - 1).cast("long")).drop(
        "_cell", "_nth", "_off"
    )


def placed(docs: DataFrame, shards: int = 24, per_shard: int = 256,
           cell_rows: int = 100_000) -> DataFrame:
    """``doc_id, grp, size, text_crc32, shard, slot`` of every row; equal texts share a shard."""
    rows = cut_lineage(docs.select(
        "doc_id",
        F.md5(text_of()).alias("grp"),
        (F.octet_length(text_of()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
    ))
    sharded = cut_lineage(assign(rows, shards, per_shard))
    return number_slots(sharded, ["doc_id", "grp"], sharded.count(), cell_rows)


def shard_table(docs: DataFrame, shards: int = 24, per_shard: int = 256) -> DataFrame:
    """The result as a table: ``law`` says which law holds; sizes come near equal."""
    return placed(docs, shards, per_shard).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_rows(docs: DataFrame, shards: int = 24, per_shard: int = 256) -> DataFrame:
    """All columns of the documents with ``shard`` and ``slot``.

    The group decides the shard, so it is the group that is joined back; slots are
    numbered over the whole rows.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*kept).alias("row"), F.md5(text_of()).alias("grp"),
                       F.col("doc_id").alias("id"))
    narrow = cut_lineage(docs.select(
        F.md5(text_of()).alias("grp"), (F.octet_length(text_of()) + ROW_BYTES).alias("size")))
    where = assign(narrow.groupBy("grp").agg(F.sum("size").alias("size")), shards, per_shard)
    out = rows.join(where.select("grp", "shard"), "grp")
    return number_slots(out, ["id", "grp"], narrow.count()).select("row.*", "shard", "slot")

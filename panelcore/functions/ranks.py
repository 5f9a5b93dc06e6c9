"""Running totals over an order that spans all rows, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.session import cut_lineage


def one_group(one_row: DataFrame, rows: DataFrame) -> DataFrame:
    """Attach a table of exactly one row (a global aggregate) to every row."""
    k = F.lit(1)
    return rows.withColumn("_k", k).join(
        F.broadcast(one_row.withColumn("_k", k)), "_k"
    ).drop("_k")


def range_split(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows tagged with their range partition ``_p``.

    The split is materialised: offsets and lookups derived from it must see the
    same split even when an executor is lost between them.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def partition_offsets(split: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """``keys, _p, _pc, _off``: weight inside each range partition and before it.

    One row per (group, range partition), so the window is as short as the number
    of partitions.
    """
    per_part = split.groupBy(*keys, "_p").agg(F.sum(weight).alias("_pc"))
    w = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    return per_part.withColumn("_off", F.coalesce(F.sum("_pc").over(w), F.lit(0)))


def global_row_number(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """1-based position of each row in the order of unique keys ``order``."""
    split = range_split(df, order)
    offsets = partition_offsets(split, [], F.lit(1)).select("_p", "_off")
    w = W.partitionBy("_p").orderBy(*order)
    return (
        split.join(offsets, "_p")
        .withColumn(name, (F.col("_off") + F.row_number().over(w)).cast("long"))
        .drop("_p", "_off")
    )

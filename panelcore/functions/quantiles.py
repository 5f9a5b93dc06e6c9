"""Exact linear-interpolation quantiles, for groups of any size.

``percentile`` keeps every distinct value of a group in one task. That is right
where a group is one entity, whose rows the period axis bounds, and wrong where
a group is pooled over all entities. ``pooled_quantiles`` serves the second case:
equal values collapse first, and what is left is ordered by range partitions whose
offsets turn a global rank into a local one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.functions.ranks import one_group, partition_offsets, range_split


def pooled_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    wanted: DataFrame | list[float],
) -> DataFrame:
    """``keys + (level, quantile)`` for few but arbitrarily large groups.

    Few means a number the caller sets (folds of a run, positions of a year), so what
    is known per group is broadcast; a group itself is never gathered.

    ``wanted`` is a list of levels, or a DataFrame ``keys + (level)`` when the level
    depends on the group. NULL values are ignored.
    """
    # Equal values collapse before anything is ordered, so a value that holds a
    # third of all rows costs one row from here on.
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if isinstance(wanted, list):
        levels = F.explode(F.array(*[F.lit(float(q)) for q in wanted]))
        ranks = totals.withColumn("level", levels)
    else:
        ranks = totals.join(wanted, keys) if keys else one_group(totals, wanted)
    # Both neighbours of the fractional rank (n-1)*level, as 1-based integer ranks.
    h = F.col("level") * (F.col("_n") - 1)
    ranks = ranks.select(
        *keys, "level", "_n", h.alias("_h"),
        F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))).alias("_r0"),
    ).withColumn("_rank", F.col("_r0") + 1)

    # A handful of ranks per group travel to the values as one array.
    per_group = ranks.groupBy(*keys).agg(
        F.collect_set(F.struct("level", "_h", "_r0", "_rank")).alias("_ranks")
    )
    return _interpolate(_ranged(counts, per_group, keys), keys)


def _with_ranks(rows: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(per_group), keys) if keys else one_group(per_group, rows)


def _ranged(counts: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks looked up across range partitions, so no group sits in one task."""
    split = range_split(counts, [*keys, "_v"])
    offsets = _with_ranks(partition_offsets(split, keys, F.col("_c")), per_group, keys)
    wanted = F.filter("_ranks", lambda r: (r["_rank"] > F.col("_off"))
                      & (r["_rank"] <= F.col("_off") + F.col("_pc")))
    # At most two range partitions per wanted rank remain; all others are dropped by
    # the join before anything is ordered.
    per_split = offsets.select(*keys, "_p", "_off", wanted.alias("_ranks")).where(
        F.size("_ranks") > 0
    )
    inside = W.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    running = (
        split.join(F.broadcast(per_split), [*keys, "_p"])
        .withColumn("_hi", F.col("_off") + F.sum("_c").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )
    return _matching(running, keys)


def _matching(running: DataFrame, keys: list[str]) -> DataFrame:
    hit = F.filter("_ranks", lambda r: (r["_rank"] > F.col("_lo")) & (r["_rank"] <= F.col("_hi")))
    return running.select(*keys, "_v", F.explode(hit).alias("r")).select(
        *keys, "r.level", "r._h", "r._r0", "_v"
    )


def _interpolate(found: DataFrame, keys: list[str]) -> DataFrame:
    low = F.min(F.struct("_r0", "_v"))["_v"]
    high = F.max(F.struct("_r0", "_v"))["_v"]
    frac = F.first("_h") - F.floor(F.first("_h"))
    return found.groupBy(*keys, "level").agg((low + (high - low) * frac).alias("quantile"))

"""Exposure between census years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.checks import ContractError

DAYS_PER_YEAR = 365.25


def check_anchors(anchors: DataFrame) -> None:
    """Numeric year, population and area; area and population positive."""
    bad = anchors.where(
        "entity is null or year is null or population is null or area is null "
        "or population <= 0 or area <= 0"
    ).take(2)
    if bad:
        raise ContractError(f"unusable census rows, e.g. {bad[0].asDict()}")


def interpolate_anchors(anchors: DataFrame, grid: DataFrame) -> DataFrame:
    """``exposure`` and ``density`` for every grid row.

    Growth between anchors is geometric; outside them the nearest anchor holds.
    Density divides by the area of the earliest anchor. Anchors and grid rows are
    merged on the time axis, so each row finds its neighbours in one ordered pass
    over an entity instead of a range join.
    """
    t = F.year("period") + (F.dayofyear("period") - 1) / F.lit(DAYS_PER_YEAR)
    points = anchors.select(
        "entity",
        F.lit(None).cast("date").alias("period"),
        F.col("year").cast("double").alias("t"),
        F.struct(F.col("year").cast("double").alias("t"),
                 F.log("population").alias("lp")).alias("a"),
        F.struct("year", "area").alias("land"),
    )
    rows = grid.select("entity", "period", t.alias("t")).unionByName(
        points, allowMissingColumns=True
    )
    # Anchors sort before grid rows of the same instant in both directions.
    is_grid = F.col("period").isNotNull()
    past = W.partitionBy("entity").orderBy("t", is_grid).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("entity").orderBy(F.desc("t"), is_grid).rowsBetween(
        W.unboundedPreceding, 0
    )
    whole = W.partitionBy("entity")
    found = rows.select(
        "entity", "period", "t",
        F.last("a", ignorenulls=True).over(past).alias("lo"),
        F.last("a", ignorenulls=True).over(ahead).alias("hi"),
        F.min("land").over(whole)["area"].alias("area"),
    ).where(is_grid)
    lo, hi = F.col("lo"), F.col("hi")
    share = F.try_divide(F.col("t") - lo["t"], hi["t"] - lo["t"])
    log_pop = F.when(lo.isNull(), hi["lp"]).when(hi.isNull(), lo["lp"]).otherwise(
        lo["lp"] + (hi["lp"] - lo["lp"]) * F.coalesce(share, F.lit(0.0))
    )
    return found.select("entity", "period", F.exp(log_pop).alias("exposure"), "area").select(
        "entity", "period", "exposure", (F.col("exposure") / F.col("area")).alias("density")
    )

"""Gridded fields: population weights, weighted means, units and humidity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcore.checks import ContractError
from panelcore.functions.scalars import relative_humidity

# Zero Celsius in kelvin, millimetres per metre.
KELVIN_OFFSET = 273.15
MM_PER_M = 1000.0
WEIGHT_TOLERANCE = 1e-6


def grid_weights(cells: DataFrame) -> DataFrame:
    """``entity, cell, weight`` summing to 1 per entity, from cell populations.

    Totals are aggregated map-side and joined back, so an entity that owns a third
    of all cells is never gathered in one task.
    """
    assigned = cells.where("entity is not null")
    totals = assigned.groupBy("entity").agg(
        F.sum("population").alias("total"), F.min("population").alias("lowest")
    )
    bad = totals.where("lowest < 0 or total <= 0 or total is null").select("entity").take(3)
    if bad:
        raise ContractError(f"populations are negative or all zero for {[r[0] for r in bad]}")
    return assigned.join(totals, "entity").select(
        "entity", "cell", (F.col("population") / F.col("total")).alias("weight")
    )


def check_weights(weights: DataFrame) -> None:
    off = (
        weights.groupBy("entity").agg(F.sum("weight").alias("w"))
        .where(F.abs(F.col("w") - 1.0) > WEIGHT_TOLERANCE).take(1)
    )
    if off:
        raise ContractError(f"weights of {off[0][0]!r} sum to {off[0][1]:.6f}, not 1")


def grid_to_entity(values: DataFrame, weights: DataFrame, variable: str) -> DataFrame:
    """Weighted mean of ``cell, period, value`` per entity and period.

    A cell that is missing makes the mean missing: the cells of a period are
    counted against the cells the entity owns.
    """
    owned = weights.groupBy("entity").agg(F.count(F.lit(1)).alias("n_cells"))
    weighted = (
        values.join(weights, "cell")
        .groupBy("entity", "period")
        .agg(
            F.sum(F.col("value") * F.col("weight")).alias("total"),
            F.count("value").alias("n_seen"),
        )
    )
    return weighted.join(owned, "entity").select(
        "entity",
        "period",
        F.lit(variable).alias("variable"),
        F.when(F.col("n_seen") == F.col("n_cells"), F.col("total")).alias("value"),
    )


def to_panel_units(long: DataFrame) -> DataFrame:
    """Kelvin to Celsius for temperatures, metres to millimetres for rainfall."""
    v = F.col("value")
    return long.withColumn(
        "value",
        F.when(F.col("variable").isin("temperature", "dewpoint"), v - KELVIN_OFFSET)
        .when(F.col("variable") == "rainfall", v * MM_PER_M)
        .otherwise(v),
    )


def derive_humidity(long: DataFrame) -> DataFrame:
    """Replace dewpoint rows by relative humidity, keeping all others."""

    def pick(name: str):
        return F.avg(F.when(F.col("variable") == name, F.col("value")))

    pair = (
        long.where(F.col("variable").isin("temperature", "dewpoint"))
        .groupBy("entity", "period")
        .agg(pick("temperature").alias("t"), pick("dewpoint").alias("d"))
    )
    humidity = pair.select(
        "entity",
        "period",
        F.lit("humidity").alias("variable"),
        relative_humidity(F.col("t"), F.col("d")).alias("value"),
    )
    kept = long.where(F.col("variable") != "dewpoint").select(*humidity.columns)
    return kept.unionByName(humidity)

"""Facts to panel: pre-aggregation, the complete grid, and fusing sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcore.functions.scalars import period_start
from panelcore.params import Calendar


def complete_grid(entities: DataFrame, calendar: Calendar, attributes: tuple[str, ...] = (),
                  unique: bool = False, tasks: int | None = None) -> DataFrame:
    """Every (entity, period); the first period starts on or after the window start.

    Each entity row generates its own periods, so the dense rows are never shuffled,
    and constant ``attributes`` of the entity travel along instead of being joined
    back. The partition count is fixed: judged by the few bytes that are shuffled
    here, adaptive execution would merge the tasks that multiply them. ``tasks`` sets it for
    a grid that ``spark.sql.shuffle.partitions`` is too few for; ``unique`` says that
    ``entities`` already has one row each.
    """
    start = F.lit(calendar.start)
    snapped = period_start(start, calendar)
    step = F.expr("interval 1 month" if calendar.granularity == "monthly" else "interval 1 week")
    following = F.to_date(snapped + step)
    first = F.when(snapped >= start, snapped).otherwise(following)
    end = F.lit(calendar.end)
    axis = F.when(first <= end, F.sequence(first, end, step))
    rows = entities.select("entity", *attributes)
    if not unique:
        rows = rows.dropDuplicates(["entity"])
    tasks = tasks or int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "entity").select(
        "entity", F.explode(axis).alias("period"), *attributes
    )


def on_grid(grid: DataFrame, observed: DataFrame) -> DataFrame:
    """Left join onto the grid; what was not observed is NULL."""
    return grid.join(observed, ["entity", "period"], "left")


def period_facts(facts: DataFrame, key: str, moment: Column, value: str,
                 calendar: Calendar) -> DataFrame:
    """Facts reduced to one row per (key, period) before any join.

    The map-side partial aggregate collapses a key that holds a third of all rows to
    one row per period, so the join that follows moves aggregates, not facts. A fact
    outside the calendar fails the job: the grid has no row for it.
    """
    inside = moment.isNull() | moment.between(F.lit(calendar.start), F.lit(calendar.end))
    checked = F.when(inside, moment).otherwise(
        F.raise_error(F.concat(F.lit("outside the calendar: "), moment.cast("string"))))
    return facts.groupBy(F.col(key), period_start(checked, calendar).alias("period")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        F.max(value).alias("top"),
    )


def entity_facts(partials: DataFrame, membership: DataFrame, key: str, member_key: str
                 ) -> DataFrame:
    """Second aggregation step: partials to their entity (count, mean, maximum)."""
    joined = partials.join(membership, partials[key] == membership[member_key])
    return joined.groupBy("entity", "period").agg(
        F.sum("n").cast("double").alias("n"),
        (F.sum("total") / F.sum("n")).alias("mean"),
        F.max("top").alias("top"),
    )


def fuse(sources: list[DataFrame], variables: list[str], grid: DataFrame) -> DataFrame:
    """One wide panel from long sources; the first non-null value of a cell is kept.

    The variable list is passed to ``pivot``, which saves the job that would look
    for distinct values. Where a key has several values the smallest one wins, so
    that the result does not depend on row order; contract checks reject such keys.
    """
    rows = sources[0]
    for other in sources[1:]:
        rows = rows.unionByName(other)
    wide = rows.groupBy("entity", "period").pivot("variable", variables).agg(F.min("value"))
    return on_grid(grid, wide)

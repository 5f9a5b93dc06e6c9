"""From whatever a source emits to contract rows inside the study window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcore.checks import ContractError, check_long
from panelcore.functions.scalars import nan_to_null, period_start
from panelcore.params import Calendar
from panelcore.sources.registry import normalise_entity


def snap_period(df: DataFrame, calendar: Calendar, column: str = "period") -> DataFrame:
    """Dates to the start of their period (weeks start on Monday).

    A text that is present but no date fails the job rather than losing the row.
    """
    if isinstance(df.schema[column].dataType, T.StringType):
        short = F.col(column).rlike(r"^\d{4}-\d{2}$")
        text = F.when(short, F.concat(column, F.lit("-01"))).otherwise(F.col(column))
        parsed = F.try_to_timestamp(text)
        moment = F.when(
            F.col(column).isNotNull() & parsed.isNull(),
            F.raise_error(F.concat(F.lit("not a date: "), F.col(column))).cast("timestamp"),
        ).otherwise(parsed)
    else:
        moment = F.col(column)
    return df.withColumn(column, period_start(moment, calendar))


def restrict(df: DataFrame, entities: DataFrame | None, calendar: Calendar) -> DataFrame:
    """Studied entities and the inclusive window, after naming and snapping."""
    kept = df.where(F.col("period").between(F.lit(calendar.start), F.lit(calendar.end)))
    if entities is None:
        return kept
    return kept.join(entities.select("entity").distinct(), "entity", "left_semi")


def conform(raw: DataFrame, calendar: Calendar, declared, registry: DataFrame | None = None,
            entities: DataFrame | None = None, check: bool = True) -> DataFrame:
    """The source plug-in contract: normalise, snap, restrict, then check."""
    df = nan_to_null(raw)
    if registry is not None:
        df = normalise_entity(df, registry)
    df = restrict(snap_period(df, calendar), entities, calendar)
    if not set(declared):
        raise ContractError("a source must declare its variables")
    return check_long(df, declared) if check else df

"""Time-based splits as a table of roles; rows stay where they are."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.params import FoldParams


class SplitError(ValueError):
    """The periods cannot support the requested geometry."""


def distinct_periods(samples: DataFrame) -> list[date]:
    """The period axis of the samples: hundreds of dates, whatever the row count."""
    return [r[0] for r in samples.select("period").distinct().orderBy("period").collect()]


def available_folds(samples: DataFrame, p: FoldParams) -> DataFrame:
    """One row ``n_periods, n_folds``: how many test blocks fit behind the first fit block."""
    last_start = F.col("n_periods") - (p.initial_train + p.test_size)
    starts = F.when(last_start >= 0, F.size(F.sequence(F.lit(0).cast("long"), last_start, F.lit(p.step).cast("long"))))
    return samples.agg(F.count_distinct("period").alias("n_periods")).withColumn(
        "n_folds", F.coalesce(starts, F.lit(0)).cast("long"))


def rolling_origin(samples: DataFrame, p: FoldParams, horizon: int) -> DataFrame:
    """``fold, period, role`` (fit, val, test) over the numbered periods of the samples.

    A fold's test block starts at period number ``initial_train + fold * step``. What lies
    at least ``horizon`` periods before it is usable (the rest is the embargo), and the
    last ``validation_fraction`` of that validates. Fewer folds than configured is an
    error, never a silent reduction. The table has folds times periods rows.
    """
    n_periods, possible = available_folds(samples, p).first()
    if possible < p.n_folds:
        raise SplitError(
            f"{n_periods} periods support {possible} fold(s), {p.n_folds} were asked for")
    if p.initial_train <= horizon:
        raise SplitError(f"initial_train {p.initial_train} must exceed the horizon {horizon}")
    # The window numbers the period axis, not the rows.
    axis = samples.select("period").distinct().withColumn(
        "_i", F.row_number().over(W.orderBy("period")) - 1)
    plan = axis.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(p.n_folds - 1))))
    test = p.initial_train + F.col("fold") * p.step
    usable = test - horizon
    border = usable - F.greatest(
        F.lit(1), F.bround(usable * F.lit(p.validation_fraction)).cast("int"))
    if p.initial_train - horizon <= max(1, round((p.initial_train - horizon) * p.validation_fraction)):
        raise SplitError("fold 0: validation leaves no period to fit on")
    role = (
        F.when(F.col("_i") < border, "fit")
        .when(F.col("_i") < usable, "val")
        .when((F.col("_i") >= test) & (F.col("_i") < test + p.test_size), "test")
    )
    return plan.select("fold", "period", role.alias("role")).where("role is not null")


def fold_numbers(p: FoldParams) -> list[int]:
    return list(range(p.n_folds))


def assign_folds(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """Samples repeated per fold they take part in, with their role.

    The plan has folds times periods rows, so it is always broadcast.
    """
    return samples.join(F.broadcast(plan), "period")


def fold_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


def tail_cutoff(samples: DataFrame, n_last: int) -> date:
    """First of the last ``n_last`` distinct periods."""
    periods = distinct_periods(samples)
    if not 0 < n_last < len(periods):
        raise SplitError(f"cannot hold out {n_last} of {len(periods)} periods")
    return periods[-n_last]


def tail_split(samples: DataFrame, n_last: int) -> tuple[DataFrame, DataFrame]:
    """Everything before the last ``n_last`` distinct periods, and those periods."""
    cutoff = F.lit(tail_cutoff(samples, n_last))
    return samples.where(F.col("period") < cutoff), samples.where(F.col("period") >= cutoff)

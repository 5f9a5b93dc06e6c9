"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcore.params import Calendar, TargetParams


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; Spark's aggregates would count it as a value."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            cols.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def finite(c: Column) -> Column:
    """True only for present, finite values."""
    return F.coalesce((F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c), F.lit(False))


def rate(target: Column, exposure: Column, per: float) -> Column:
    return F.try_divide(target, exposure) * F.lit(float(per))


def target_level(p: TargetParams) -> Column:
    """The target on the scale that is modelled."""
    r = rate(F.col(p.target), F.col(p.exposure), p.per)
    return F.log1p(r) if p.transform == "log1p" else r


def inverse_target(c: Column, transform: str) -> Column:
    """Back to the reported scale, never below zero; identity without a transform."""
    if transform != "log1p":
        return c
    # greatest() skips NULLs, and a missing level must not turn into a rate of zero.
    return F.when(c.isNotNull(), F.greatest(F.expm1(c), F.lit(0.0)))


def unfloored_rate(c: Column, transform: str) -> Column:
    """Back-transform used for scoring, where flooring would hide an error."""
    return F.expm1(c) if transform == "log1p" else c


def slug(c: Column) -> Column:
    """Comparison key: case, spacing, punctuation and ampersands do not matter."""
    return F.regexp_replace(
        F.replace(F.lower(F.trim(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", ""
    )


def period_start(c: Column, calendar: Calendar) -> Column:
    return F.trunc(F.to_date(c), calendar.unit)


def shift_period(c: Column, n, calendar: Calendar) -> Column:
    """The period ``n`` steps later; ``n`` is an int or a Column."""
    steps = F.lit(n) if isinstance(n, int) else n
    if calendar.granularity == "monthly":
        return F.add_months(c, steps.cast("int"))
    return F.date_add(c, (steps * 7).cast("int"))


def periods_between(start: Column, end: Column, calendar: Calendar) -> Column:
    """Signed whole periods from one period start to another."""
    if calendar.granularity == "monthly":
        return (
            (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
        ).cast("int")
    return F.floor(F.datediff(end, start) / 7).cast("int")


def year_position(c: Column, calendar: Calendar) -> Column:
    """Month or ISO week, counted from 0. Week 53 shares the angle of week 1."""
    pos = F.month(c) if calendar.granularity == "monthly" else F.weekofyear(c)
    return pos - 1


def profile_position(c: Column, calendar: Calendar) -> Column:
    """Position used by seasonal profiles: months, or day-of-year scaled to weeks."""
    if calendar.granularity == "monthly":
        return F.month(c) - 1
    return F.floor((F.dayofyear(c) - 1) * calendar.per_year / 366).cast("int")


def cyclic(c: Column, calendar: Calendar) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * year_position(c, calendar) / F.lit(float(calendar.per_year))
    return F.sin(angle), F.cos(angle)


def position_from_cyclic(sin: Column, cos: Column, per_year: int) -> Column:
    """Invert the sine/cosine pair exactly."""
    turns = F.atan2(sin, cos) / F.lit(2.0 * math.pi) * F.lit(float(per_year))
    return F.pmod(F.bround(turns).cast("int"), F.lit(per_year))


def damped_steps(steps: Column, damping: float) -> Column:
    """phi + phi^2 + ... + phi^steps; a straight count at phi = 1."""
    n = steps.cast("double")
    if damping >= 1.0:
        total = n
    elif damping <= 0.0:
        total = F.lit(0.0)
    else:
        total = F.lit(damping / (1.0 - damping)) * (F.lit(1.0) - F.pow(F.lit(damping), n))
    return F.when(n <= 0, F.lit(0.0)).otherwise(total)


def relative_humidity(temperature_c: Column, dewpoint_c: Column) -> Column:
    """Magnus approximation, in percent."""
    # The Magnus coefficients.
    a, b = 17.625, 243.04

    def pressure(t: Column) -> Column:
        return F.exp(F.lit(a) * t / (F.lit(b) + t))

    return F.lit(100.0) * pressure(dewpoint_c) / pressure(temperature_c)

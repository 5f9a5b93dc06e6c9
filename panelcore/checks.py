"""Contract checks: one aggregate job each, raising on the driver with examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcore.functions.scalars import finite

KEYS = ("entity", "period")
LONG_COLUMNS = ("entity", "period", "variable", "value")


class ContractError(ValueError):
    """Input that breaks the contract of the stage it enters."""


def require_columns_present(df: DataFrame, needed) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ContractError(f"missing column(s) {missing}; found {df.columns}")


def require_same_columns(expected, actual, expected_steps: int, actual_steps: int) -> None:
    """Scored features must be the fitted ones, in order, over the same window."""
    if list(expected) != list(actual):
        odd = sorted(set(expected) ^ set(actual)) or "their order"
        raise ContractError(f"scored columns differ from fitted columns: {odd}")
    if expected_steps != actual_steps:
        raise ContractError(f"fitted on {expected_steps} steps, scored on {actual_steps}")


def contract_findings(long: DataFrame, declared) -> DataFrame:
    """Every breach found in long rows: ``rule, n, examples``; empty when clean.

    All rules share one pass over the keys: duplicates are seen after the map-side
    count per key, undeclared variables and odd values on the same grouped rows. Rows that
    were counted before carry ``n_rows`` and ``n_nan`` in place of ``value``.
    """
    counted = "n_rows" in long.columns
    nan = F.isnan(F.col("value").cast("double")) if not counted else F.lit(False)
    keyed = long.groupBy("entity", "period", "variable").agg(
        (F.sum("n_rows") if counted else F.count(F.lit(1))).alias("n_rows"),
        (F.sum("n_nan") if counted else F.count_if(nan)).alias("n_nan"),
    )
    label = F.concat_ws("/", "entity", F.col("period").cast("string"), "variable")
    rules = F.array_compact(
        F.array(
            F.when(F.col("n_rows") > 1, F.lit("duplicate key")),
            F.when(F.col("n_nan") > 0, F.lit("not a number")),
            F.when(F.col("entity").isNull() | F.col("period").isNull(), F.lit("missing key")),
            F.when(~F.coalesce(F.col("variable").isin(list(declared)), F.lit(False)),
                   F.lit("undeclared variable")),
        )
    )
    return (
        keyed.select(F.explode(rules).alias("rule"), label.alias("key"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"),
             F.max("key").alias("last_key"))
    )


def check_long(long: DataFrame, declared) -> DataFrame:
    """Raise unless the long rows obey the source contract; returns them unchanged."""
    require_columns_present(long, LONG_COLUMNS)
    if not isinstance(long.schema["value"].dataType, T.NumericType):
        raise ContractError("value must be numeric")
    if long.isEmpty():
        raise ContractError("the source produced no rows")
    found = contract_findings(long, declared).collect()
    if found:
        raise ContractError(
            "; ".join(f"{r['rule']}: {r['n']} (e.g. {r['first_key']})" for r in found)
        )
    return long


def require_single_owner(declared_by_source: dict[str, tuple[str, ...]]) -> None:
    """A variable may come from one source only."""
    owner: dict[str, str] = {}
    for source, variables in declared_by_source.items():
        for v in variables:
            if v in owner:
                raise ContractError(f"{v!r} is emitted by both {owner[v]!r} and {source!r}")
            owner[v] = source


def require_panel(panel: DataFrame) -> None:
    """Keys first, then numeric or boolean measures only."""
    require_columns_present(panel, KEYS)
    odd = [
        f.name for f in panel.schema.fields
        if f.name not in KEYS and not isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    if odd:
        raise ContractError(f"panel columns must be numeric; {odd} are not")


def require_dense(panel: DataFrame) -> None:
    """Window positions are only periods on a complete grid: every entity carries
    the same number of distinct periods, without duplicates."""
    r = (
        panel.groupBy("entity")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("period").alias("d"),
             F.min("period").alias("a"), F.max("period").alias("b"))
        .agg(F.min("n"), F.max("n"), F.count_if(F.col("n") != F.col("d")),
             F.count_distinct("a", "b"))
        .first()
    )
    if r[0] is None:
        raise ContractError("the panel has no rows")
    if r[0] != r[1] or r[2] or r[3] != 1:
        raise ContractError(f"the grid is not complete: {r[0]} to {r[1]} rows per entity")


def finite_or_fail(column: str) -> Column:
    """The column, failing the job that reads it where a value is missing or not finite."""
    c = F.col(column)
    told = F.concat(F.lit(f"{column} is not finite: "), F.coalesce(c.cast("string"), F.lit("null")))
    return F.when(finite(c), c).otherwise(F.raise_error(told).cast("double"))


def next_period_or_fail(value: Column, previous: Column, expected: Column) -> Column:
    """``value``, failing the job that reads it where a series repeats or skips a period.

    ``previous`` is the period of the row before, ``expected`` the one that has to follow.
    """
    here = F.col("period")
    told = F.concat_ws(" ", F.lit("the grid is not complete:"), F.col("entity"),
                       previous.cast("string"), F.lit("is followed by"), here.cast("string"))
    ok = previous.isNull() | (here == expected)
    return F.when(ok, value).otherwise(F.raise_error(told).cast("double"))


def require_finite(df: DataFrame, column: str) -> None:
    bad = df.agg(F.count_if(~finite(F.col(column)))).first()[0]
    if bad:
        raise ContractError(f"{bad} non-finite value(s) in {column!r}")


def require_usable(fold_counts: DataFrame) -> None:
    """Each fold must have fit, validation and test rows (``fold, role, n``)."""
    empty = (
        fold_counts.groupBy("fold").agg(F.count_if(F.col("n") > 0).alias("roles"))
        .where("roles < 3").select("fold").collect()
    )
    if empty:
        raise ContractError(f"folds {[r[0] for r in empty]} have an empty role")

"""File readers. Columns are recognised by role, dates by name, never by position."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcore.checks import ContractError

# Header names accepted for each role.
ROLES = {
    "entity": ("state", "state/ut", "state_ut", "states/uts", "state name", "entity"),
    "period": ("date", "month", "period", "week", "year_month", "yearmonth"),
    "value": ("value", "cases", "dengue_cases", "count", "cases_reported"),
}
# Period labels accepted in headers and file names.
PERIOD_FORMATS = ("%Y-%m-%d", "%Y-%m", "%b %Y", "%B %Y", "%Y/%m", "%Y%m", "%Y")

PREAMBLE_LINES = 2


def match_role(columns: list[str], accepted) -> str | None:
    """First column carrying an accepted name, ignoring case and outer spaces."""
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[a] for a in accepted if a in by_name), None)


def _require_role(columns: list[str], role: str, roles) -> str:
    found = match_role(columns, roles[role])
    if found is None:
        raise ContractError(f"no column for {role!r} among {columns}")
    return found


def parse_period_label(label: str):
    for fmt in PERIOD_FORMATS:
        try:
            return datetime.strptime(label.strip(), fmt).date()
        except ValueError:
            continue
    return None


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_long(spark: SparkSession, path: str, variable: str, roles=ROLES) -> DataFrame:
    """One row per observation; a table with one column per period is unpivoted.

    Rows that cannot be placed (no entity or no date) go; a missing value stays,
    because it is an observed gap. The period stays text until it is snapped.
    """
    raw = spark.read.csv(path, header=True)
    period = match_role(raw.columns, roles["period"])
    if period is None:
        return unpivot_periods(raw, _require_role(raw.columns, "entity", roles), variable)
    entity = _require_role(raw.columns, "entity", roles)
    value = _require_role(raw.columns, "value", roles)
    return raw.select(
        F.col(_q(entity)).alias("entity"),
        F.col(_q(period)).alias("period"),
        F.lit(variable).alias("variable"),
        F.col(_q(value)).try_cast("double").alias("value"),
    ).where("entity is not null and period is not null")


def unpivot_periods(df: DataFrame, entity: str, variable: str) -> DataFrame:
    """Long rows from one column per period; every other header must be a date."""
    headers = [c for c in df.columns if c != entity]
    if not headers:
        raise ContractError(f"no period columns beside {entity!r}")
    dates = {h: parse_period_label(h) for h in headers}
    odd = [h for h, d in dates.items() if d is None]
    if odd:
        raise ContractError(f"header(s) {odd} are not dates")
    typed = df.select(
        F.col(_q(entity)).alias("entity"),
        *[F.col(_q(h)).try_cast("double").alias(d.isoformat()) for h, d in dates.items()],
    )
    return (
        typed.unpivot("entity", [_q(d.isoformat()) for d in dates.values()], "period", "value")
        .select("entity", "period", F.lit(variable).alias("variable"), "value")
        .where("entity is not null")
    )


def read_dated_files(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """Exports named after their period, with two preamble lines above the header.

    The period is the file's name, or that of its folder where a writer names folders
    (``p=2001-07/part-0.csv``). Files are read by line and may be split: only the part
    that starts at byte 0 holds the preamble, whose lines are counted off as they pass.
    """
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1)
    folder = F.regexp_extract("_metadata.file_path", r"=([^/=]+)/[^/]*$", 1)
    lines = spark.read.text(path).select(
        F.when(folder != "", folder).otherwise(name).alias("stem"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    body = lines.mapInArrow(_below_preamble, "stem string, line string")
    parsed = F.from_csv("line", "entity string, value string")
    iso = F.when(F.length("stem") == 7, F.concat("stem", F.lit("-01"))).otherwise(F.col("stem"))
    period = F.coalesce(
        F.try_to_date(iso, "yyyy-MM-dd"),
        F.raise_error(F.concat(F.lit("file name is not a period: "), F.col("stem"))),
    )
    return (
        body.where(F.trim("line") != "")
        .select(period.alias("period"), parsed.alias("r"))
        .select(
            F.col("r.entity").alias("entity"),
            "period",
            F.lit(variable).alias("variable"),
            F.col("r.value").try_cast("double").alias("value"),
        )
        .where("entity is not null")
    )


def _below_preamble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines below the header; a task reads the lines of a file part in order."""
    held, seen = None, 0
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        at = list(zip(b.column("file").to_pylist(), b.column("start").to_pylist()))
        for i, part in enumerate(at):
            held, seen = (part, seen + 1) if part == held else (part, 0)
            keep[i] = part[1] > 0 or seen > PREAMBLE_LINES
        yield b.select(["stem", "line"]).filter(pa.array(keep))


def broadcast_series(series: DataFrame, grid: DataFrame) -> DataFrame:
    """Give one national ``period, variable, value`` series to every entity.

    The grid already lists every (entity, period), so this is an equality join on
    the period and never a product of two tables. A series is reduced to one row per
    period before it is broadcast, and fails where it has several: that row count, which
    the period axis bounds, is what is sent; a shuffle on the period would gather all
    entities of a period in one task.
    """
    row = F.first(F.struct("variable", "value"))
    several = F.raise_error(F.concat(F.lit("several national values for "),
                                     F.col("period").cast("string")))
    once = series.groupBy("period").agg(
        F.count(F.lit(1)).alias("_n"), row.alias("_r")).select(
        "period", F.when(F.col("_n") == 1, F.col("_r.variable")).otherwise(
            several.cast("string")).alias("variable"), F.col("_r.value").alias("value"))
    return grid.select("entity", "period").join(F.broadcast(once), "period").select(
        "entity", "period", "variable", "value"
    )


def sum_terms(terms: DataFrame, variable: str) -> DataFrame:
    """Sum several search terms (``entity, period, term, value``) into one signal."""
    return terms.groupBy("entity", "period").agg(F.sum("value").alias("value")).select(
        "entity", "period", F.lit(variable).alias("variable"), "value"
    )

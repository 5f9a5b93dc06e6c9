"""Coverage, gaps, robust outliers, short-gap filling and row provenance.

An entity's rows are bounded by the period axis, so windows and exact medians per
entity stay small; every operator here needs one shuffle by entity at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.params import QualityParams

# Consistency factors of the MAD and of the mean absolute deviation.
MAD_TO_SIGMA = 1.4826
MEAN_AD_TO_SIGMA = 1.2533

MISSING, OUTLIER, INTERPOLATED, OK = "missing", "outlier", "interpolated", "ok"


def melt(panel: DataFrame, variables: list[str]) -> DataFrame:
    """``entity, period, variable, value`` from the wide panel.

    Exploding an array keeps the partitioning by entity, which ``unpivot`` gives up;
    the per-series windows that follow then need no shuffle of their own.
    """
    cells = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"))
        for v in variables
    ])
    return panel.select("entity", "period", F.inline(cells))


def _series() -> WindowSpec:
    return W.partitionBy("entity", "variable")


def missing_runs(long: DataFrame) -> DataFrame:
    """Every run of missing values: ``entity, variable, start, end, gap_length``.

    Rows of one run share the number of values seen before them.
    """
    seen = F.count("value").over(
        _series().orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        long.withColumn("_seen", seen)
        .where("value is null")
        .groupBy("entity", "variable", "_seen")
        .agg(
            F.min("period").alias("start"),
            F.max("period").alias("end"),
            F.count(F.lit(1)).alias("gap_length"),
        )
        .drop("_seen")
    )


def longest_run(long: DataFrame) -> DataFrame:
    """Longest run per series, 0 where nothing is missing."""
    per_series = long.groupBy("entity", "variable").agg(F.count(F.lit(1)).alias("_n"))
    longest = missing_runs(long).groupBy("entity", "variable").agg(
        F.max("gap_length").alias("longest")
    )
    return per_series.join(longest, ["entity", "variable"], "left").select(
        "entity", "variable", F.coalesce("longest", F.lit(0)).alias("longest_missing_run")
    )


def long_gaps(panel: DataFrame, variables: list[str], limit: int) -> DataFrame:
    """Runs too long to fill, leading and trailing ones included."""
    return missing_runs(melt(panel, variables)).where(F.col("gap_length") > limit)


def _middle(ordered: Column) -> Column:
    """Median of an ordered array; NULL when it is empty."""
    n = F.size(ordered)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2)


def _robust(values: str, prefix: str, df: DataFrame) -> DataFrame:
    """Adds ``<prefix>_median`` and ``<prefix>_scale`` of the array column ``values``.

    The scale is NULL when a series has no spread at all.
    """
    df = df.withColumn(f"{prefix}_median", _middle(F.array_sort(values)))
    dev = F.array_sort(F.transform(values, lambda x: F.abs(x - F.col(f"{prefix}_median"))))
    df = df.withColumn(f"{prefix}_dev", dev)
    first = F.lit(MAD_TO_SIGMA) * _middle(F.col(f"{prefix}_dev"))
    total = F.aggregate(f"{prefix}_dev", F.lit(0.0), lambda acc, x: acc + x)
    second = F.lit(MEAN_AD_TO_SIGMA) * F.try_divide(total, F.size(f"{prefix}_dev"))
    scale = F.when(first > 0, first).when(second > 0, second)
    return df.withColumn(f"{prefix}_scale", scale).drop(f"{prefix}_dev")


def _extremes(value: Column, series: WindowSpec, threshold: float) -> Column:
    """Whether a value lies more than ``threshold`` robust scales from its series' median.

    Median, deviation and scale are aggregates over the partition that the rows are in
    already: one pass, no join of the series with itself. Missing values are not flagged.
    """
    away = F.abs(value - F.median(value).over(series))
    first = F.lit(MAD_TO_SIGMA) * F.median(away).over(series)
    second = F.lit(MEAN_AD_TO_SIGMA) * F.avg(away).over(series)
    scale = F.when(first > 0, first).when(second > 0, second)
    return F.coalesce(F.try_divide(away, scale) > F.lit(threshold), F.lit(False))


def mad_outliers(long: DataFrame, threshold: float) -> DataFrame:
    """Long rows with ``is_outlier``; missing values are never flagged."""
    series = W.partitionBy("entity", "variable")
    flag = _extremes(F.col("value"), series, threshold)
    return long.select("entity", "period", "variable", "value", flag.alias("is_outlier"))


def detect_outliers(panel: DataFrame, variables: list[str], threshold: float) -> DataFrame:
    """Panel plus ``<variable>_outlier``: flags only, nothing is removed.

    All variables share the partitioning by entity that the panel has.
    """
    series = W.partitionBy("entity")
    flags = [_extremes(F.col(v).cast("double"), series, threshold).alias(f"{v}_outlier")
             for v in variables]
    return panel.select(*panel.columns, *flags)


def interpolate_short_gaps(panel: DataFrame, variables: list[str], method: str, limit: int
                           ) -> DataFrame:
    """Fill inner gaps whose whole run is at most ``limit``; adds ``<v>_interpolated``.

    The neighbours of a gap come from one ascending and one descending running
    frame over the same partitioning; a forward-looking frame would be quadratic.
    """
    asc = W.partitionBy("entity").orderBy("period")
    back = asc.rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("entity").orderBy(F.desc("period")).rowsBetween(
        W.unboundedPreceding, 0
    )
    numbered = panel.withColumn("_i", F.row_number().over(asc))

    def here(v: str) -> Column:
        return F.when(F.col(v).isNotNull(), F.struct(F.col(v).cast("double").alias("x"),
                                                     F.col("_i").alias("i"),
                                                     F.col("period").alias("t")))

    edges = {f"_p_{v}": F.last(here(v), ignorenulls=True).over(back) for v in variables}
    edges |= {f"_n_{v}": F.last(here(v), ignorenulls=True).over(ahead) for v in variables}
    with_edges = numbered.withColumns(edges)

    filled = []
    for c in panel.columns:
        if c not in variables:
            filled.append(F.col(c))
            continue
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        short = F.col(c).isNull() & (n["i"] - p["i"] - 1 <= limit)
        filled.append(
            F.when(short, _fill(p, n, method)).otherwise(F.col(c).cast("double")).alias(c)
        )
    flags = [
        (F.col(v).isNull()
         & F.coalesce(F.col(f"_n_{v}")["i"] - F.col(f"_p_{v}")["i"] - 1 <= limit, F.lit(False))
         ).alias(f"{v}_interpolated")
        for v in variables
    ]
    return with_edges.select(*filled, *flags)


def _fill(p: Column, n: Column, method: str) -> Column:
    if method == "time":
        share = F.datediff(F.col("period"), p["t"]) / F.datediff(n["t"], p["t"])
    else:
        share = (F.col("_i") - p["i"]) / (n["i"] - p["i"])
    if method == "nearest":
        return F.when(share <= 0.5, p["x"]).otherwise(n["x"])  # a tie goes to the earlier point
    return p["x"] + (n["x"] - p["x"]) * share


def flag_quality(panel: DataFrame, variables: list[str], filled: list[str]) -> DataFrame:
    """``data_quality`` per row: missing over outlier over interpolated over ok.

    Expects the ``_outlier`` flags of the unfilled panel and the ``_interpolated``
    flags; the flag columns of ``filled`` are always present.
    """

    def any_of(conditions: list[Column]) -> Column:
        out = F.lit(False)
        for c in conditions:
            out = out | c
        return out

    quality = (
        F.when(any_of([F.col(v).isNull() for v in variables]), F.lit(MISSING))
        .when(any_of([F.col(f"{v}_outlier") for v in variables]), F.lit(OUTLIER))
        .when(any_of([F.col(f"{v}_interpolated") for v in filled]), F.lit(INTERPOLATED))
        .otherwise(F.lit(OK))
    )
    return panel.withColumn("data_quality", quality)


def clean(panel: DataFrame, variables: list[str], p: QualityParams) -> DataFrame:
    """Outliers are judged before filling, then short gaps are filled, then rows flagged."""
    filled = [v for v in p.fill_variables if v in variables]
    flagged = detect_outliers(panel, variables, p.outlier_threshold)
    if filled:
        flagged = interpolate_short_gaps(flagged, filled, p.fill_method, p.max_gap)
    return flag_quality(flagged, variables, filled)


def clean_report(cleaned: DataFrame, variables: list[str], filled: list[str]) -> DataFrame:
    """One row: filled cells, cells still missing, outliers."""

    def total(conditions: list[Column]) -> Column:
        out = F.lit(0).cast("long")
        for c in conditions:
            out = out + F.coalesce(F.count_if(c), F.lit(0))
        return out

    return cleaned.agg(
        total([F.col(f"{v}_interpolated") for v in filled]).alias("n_interpolated"),
        total([F.col(v).isNull() for v in variables]).alias("n_still_missing"),
        total([F.col(f"{v}_outlier") for v in variables]).alias("n_outliers"),
    )


def worst_gaps(panel: DataFrame, variables: list[str], limit: int, k: int = 3) -> DataFrame:
    """The ``k`` longest gaps of the report."""
    return long_gaps(panel, variables, limit).orderBy(
        F.desc("gap_length"), "entity", "variable", "start"
    ).limit(k)


def quality_report(panel: DataFrame, variables: list[str], threshold: float) -> DataFrame:
    """Coverage, gaps, valid range and outliers per (entity, variable).

    The running counts that separate missing runs are taken on the wide panel, in one
    window by entity; everything after keeps that partitioning.
    """
    back = W.partitionBy("entity").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    counted = panel.select(
        "entity", "period", *variables, *[F.count(v).over(back).alias(f"_n_{v}") for v in variables]
    )
    cells = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"),
                 F.col(f"_n_{v}").alias("_seen"))
        for v in variables
    ])
    by_run = (
        counted.select("entity", "period", F.inline(cells))
        .groupBy("entity", "variable", "_seen")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.max("value").alias("_value"),  # a run holds at most one observed value
            F.min(F.when(F.col("value").isNotNull(), F.col("period"))).alias("_at"),
        )
    )
    report = by_run.groupBy("entity", "variable").agg(
        F.sum("_rows").alias("n_expected"),
        F.count("_value").alias("n_present"),
        F.max(F.col("_rows") - F.col("_value").isNotNull().cast("int")).alias(
            "longest_missing_run"),
        F.min("_at").alias("first_valid"),
        F.max("_at").alias("last_valid"),
        F.collect_list("_value").alias("_values"),
    )
    score = lambda x: F.try_divide(F.abs(x - F.col("_s_median")), F.col("_s_scale"))
    outliers = F.size(F.filter(
        "_values", lambda x: F.coalesce(score(x) > F.lit(threshold), F.lit(False))))
    share = F.coalesce(F.try_divide(F.col("n_outliers"), F.col("n_present")), F.lit(0.0))
    return (
        _robust("_values", "_s", report)
        .withColumn("n_outliers", outliers.cast("long"))
        .select(
            "entity", "variable", "n_expected", "n_present",
            (F.col("n_present") / F.col("n_expected")).alias("coverage"),
            (F.col("n_expected") - F.col("n_present")).alias("n_missing"),
            "longest_missing_run", "first_valid", "last_valid", "n_outliers",
            share.alias("pct_outliers"),
        )
    )


def entity_coverage(report: DataFrame) -> DataFrame:
    """Mean coverage over the variables of each entity."""
    return report.groupBy("entity").agg(F.avg("coverage").alias("coverage"))


def low_coverage(report: DataFrame, minimum: float) -> DataFrame:
    return entity_coverage(report).where(F.col("coverage") < minimum)


def summarise(panel: DataFrame, variables: list[str], p: QualityParams,
              boundary_entities: DataFrame | None = None) -> DataFrame:
    """One row of the facts that decide the modelling plan."""
    present = F.lit(0)
    for v in variables:
        present = present + F.col(v).isNotNull().cast("int")
    per_entity = panel.groupBy("entity").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_distinct("period").alias("_periods"),
        F.min("period").alias("_first"),
        F.max("period").alias("_last"),
        F.sum(present).alias("_present"),
    )
    # With one denominator per entity, the mean over variables is present / cells.
    share = F.col("_present") / (F.col("_rows") * len(variables))
    if boundary_entities is not None:
        marked = boundary_entities.select("entity", F.lit(1).alias("_b"))
        per_entity = per_entity.join(marked, "entity", "left")
    else:
        per_entity = per_entity.withColumn("_b", F.lit(None).cast("int"))
    return per_entity.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.sum("_rows").alias("n_rows"),
        F.max("_periods").alias("periods_per_entity"),
        F.min("_first").alias("first_period"),
        F.max("_last").alias("last_period"),
        F.lit(len(variables)).cast("long").alias("n_variables"),
        (F.sum("_present") / (F.sum("_rows") * len(variables))).alias("overall_coverage"),
        F.count_if(share < p.min_coverage).alias("n_low_coverage"),
        F.count("_b").alias("n_boundary_affected"),
        (F.max("_periods") < p.min_periods_per_entity).alias("pooling_required"),
    )

import pytest
from conftest import calendar, months, series
from pyspark.sql import functions as F

from panelcore.checks import ContractError, require_dense
from panelcore.operators import quality
from panelcore.operators.panel import complete_grid, fuse, on_grid
from panelcore.params import Calendar, QualityParams
from datetime import date

X = None


def _long(spark, values):
    return quality.melt(series(spark, values), ["cases"])


@pytest.mark.parametrize("values, longest", [
    ([X, 1, X, 1, X, 1], 1), ([1, X, X, X, 1, 1], 3), ([1, 1], 0), ([X, X], 2)])
def test_longest_run(spark, values, longest):
    assert quality.longest_run(_long(spark, values)).first()["longest_missing_run"] == longest


@pytest.mark.parametrize("values, flagged", [
    ([10] * 20 + [500], [20]),        # plain MAD of 0 falls back to the mean deviation
    ([0] * 30 + [250], [30]),
    ([7] * 12, []),
    ([X] * 12, []),
    ([1, 2, 3, 2, 1, 2, 3, X, 2, 90], [9]),
])
def test_outliers(spark, values, flagged):
    rows = quality.mad_outliers(_long(spark, values), 5.0).orderBy("period").collect()
    assert [i for i, r in enumerate(rows) if r["is_outlier"]] == flagged


def test_report_of_a_five_month_hole(spark):
    values = [float(i % 12) for i in range(36)]
    values[10:15] = [X] * 5
    r = quality.quality_report(series(spark, values), ["cases"], 5.0).first()
    assert (r["n_expected"], r["n_missing"], r["longest_missing_run"]) == (36, 5, 5)
    assert r["coverage"] == pytest.approx(31 / 36)
    assert (r["first_valid"], r["last_valid"]) == (months(36, 2015)[0], months(36, 2015)[35])


def test_report_of_an_empty_series(spark):
    r = quality.quality_report(series(spark, [X, X, X]), ["cases"], 5.0).first()
    assert (r["n_present"], r["coverage"], r["n_outliers"], r["pct_outliers"]) == (0, 0.0, 0, 0.0)
    assert r["longest_missing_run"] == 3 and r["first_valid"] is None


@pytest.mark.parametrize("method, filled", [("linear", [2, 3]), ("nearest", [1, 4])])
def test_short_inner_gap_is_filled(spark, method, filled):
    df = quality.interpolate_short_gaps(series(spark, [1, X, X, 4]), ["cases"], method, 2)
    rows = df.orderBy("period").collect()
    assert [r["cases"] for r in rows[1:3]] == pytest.approx(filled)
    assert [r["cases_interpolated"] for r in rows] == [False, True, True, False]


def test_nearest_tie_goes_to_the_earlier_point(spark):
    df = quality.interpolate_short_gaps(series(spark, [1, X, 9]), ["cases"], "nearest", 2)
    assert df.orderBy("period").collect()[1]["cases"] == 1.0


def test_time_method_weighs_days(spark):
    df = quality.interpolate_short_gaps(series(spark, [0, X, 59]), ["cases"], "time", 2)
    assert df.orderBy("period").collect()[1]["cases"] == pytest.approx(31.0)


def test_long_and_edge_gaps_stay(spark):
    values = [X, 1, X, X, X, 2, X]
    rows = quality.interpolate_short_gaps(series(spark, values), ["cases"], "linear", 2).orderBy(
        "period").collect()
    assert [r["cases"] for r in rows] == values
    gaps = quality.long_gaps(series(spark, values), ["cases"], 2).collect()
    assert [g["gap_length"] for g in gaps] == [3]


def test_severity_order_and_report(spark):
    n = 12
    cases = [10.0, 11.0, 9.0, 10.5] * 3
    rain = list(cases)
    rain[2] = X                   # filled
    cases[5] = X                  # stays missing: not a fill variable
    cases[8] = 900.0              # outlier
    panel = series(spark, cases).join(series(spark, rain, column="rain"), ["entity", "period"])
    p = QualityParams(fill_variables=("rain",), max_gap=2)
    cleaned = quality.clean(panel, ["cases", "rain"], p)
    flags = [r["data_quality"] for r in cleaned.orderBy("period").collect()]
    assert flags[2] == "interpolated" and flags[5] == "missing" and flags[8] == "outlier"
    assert flags.count("ok") == n - 3
    r = quality.clean_report(cleaned, ["cases", "rain"], ["rain"]).first()
    assert (r["n_interpolated"], r["n_still_missing"], r["n_outliers"]) == (1, 1, 1)


def test_cleaning_twice_changes_nothing(spark):
    p = QualityParams(fill_variables=("cases",), max_gap=2)
    once = quality.clean(series(spark, [1, X, 3, 2, X, X, X, 1]), ["cases"], p)
    twice = quality.clean(once.select("entity", "period", "cases"), ["cases"], p)
    key = lambda df: [r["cases"] for r in df.orderBy("period").collect()]
    assert key(once) == key(twice)


def test_grid_is_complete_and_starts_inside_the_window(spark):
    names = spark.createDataFrame([("a",), ("b",), ("a",)], "entity string")
    grid = complete_grid(names, calendar(36))
    assert grid.count() == 72
    require_dense(grid)
    weeks = complete_grid(names, Calendar(date(2020, 1, 1), date(2020, 1, 31), "weekly"))
    assert [r[0] for r in weeks.where("entity = 'a'").orderBy("period").select("period").collect()
            ] == [date(2020, 1, d) for d in (6, 13, 20, 27)]
    assert complete_grid(names, Calendar(date(2020, 1, 15), date(2020, 3, 31))).agg(
        F.min("period")).first()[0] == date(2020, 2, 1)


def test_incomplete_grid_is_rejected(spark):
    two = series(spark, [1, 2]).unionByName(series(spark, [1], entity="b"))
    with pytest.raises(ContractError):
        require_dense(two)


def test_fusion_keeps_one_sided_cells_null(spark):
    schema = "entity string, period date, variable string, value double"
    jan, feb = date(2015, 1, 1), date(2015, 2, 1)
    cases = spark.createDataFrame(
        [("k", jan, "cases", 10.0), ("k", feb, "cases", 20.0), ("o", jan, "cases", 30.0)], schema)
    rain = spark.createDataFrame(
        [("k", jan, "rain", 100.0), ("o", jan, "rain", 200.0), ("o", feb, "rain", 300.0)], schema)
    grid = complete_grid(cases.select("entity"), Calendar(jan, feb))
    rows = {(r["entity"], r["period"]): (r["cases"], r["rain"])
            for r in fuse([cases, rain], ["cases", "rain"], grid).collect()}
    assert rows == {("k", jan): (10.0, 100.0), ("k", feb): (20.0, X), ("o", jan): (30.0, 200.0),
                    ("o", feb): (X, 300.0)}
    assert on_grid(grid, cases.select("entity", "period", "value")).count() == 4


def test_summary(spark):
    p = QualityParams(min_coverage=0.8, min_periods_per_entity=80)
    panel = series(spark, [1, X, X, 2]).unionByName(series(spark, [1, 2, 3, 4], entity="b"))
    r = quality.summarise(panel, ["cases"], p).first()
    assert (r["n_entities"], r["n_rows"], r["n_low_coverage"]) == (2, 8, 1)
    assert r["overall_coverage"] == pytest.approx(0.75) and r["pooling_required"]

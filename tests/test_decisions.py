import dataclasses
from datetime import date

import numpy as np
import pandas as pd
import pytest
from conftest import TARGET, calendar, series, wave_panel
from pyspark.sql import functions as F

from panelcore.checks import ContractError
from panelcore.functions.scalars import damped_steps, inverse_target
from panelcore.operators import evaluate, project, risk, seasonal, serving, whatif
from panelcore.params import (
    ClampParams,
    FeatureParams,
    ParamError,
    ProjectionParams,
    RiskParams,
    Scenario,
    SeasonalParams,
)
from panelcore.plans import production
from panelcore.plans.production import Experiment, Setting

RISK = RiskParams()
D = date(2020, 1, 1)


def _forecasts(spark, rows):
    schema = ("entity string, origin_date date, target_date date, predicted_log double, "
              "lower_log double, upper_log double, predicted_rate double, lower_rate double, "
              "upper_rate double")
    full = [(e, D, date(2020, 2, 1), *map(float, (p, lo, u, *np.expm1([p, lo, u]))))
            for e, p, lo, u in rows]
    return spark.createDataFrame(full, schema)


def _bounds(spark, rows):
    schema = ("entity string, tier_index int, tier string, value_log double, value_rate double, "
              "label string, n_observations long")
    return spark.createDataFrame(
        [(e, i, RISK.tiers[i], float(v), float(np.expm1(v)), "label", 36) for e, i, v in rows],
        schema)


def test_quantile_thresholds_are_linear_quantiles(spark):
    levels = series(spark, [1, 2, None, 4, 10], column="target_level")
    rows = risk.thresholds(levels, RISK, "log1p").orderBy("tier_index").collect()
    x = [1, 2, 4, 10]
    assert [r["value_log"] for r in rows] == pytest.approx(list(np.quantile(x, [0.75, 0.9])))
    assert [r["tier"] for r in rows] == ["MEDIUM", "HIGH"] and rows[0]["n_observations"] == 4


def test_ewma_matches_pandas(spark):
    values = [1.0, 2.0, None, 4.0, 3.0, 8.0]
    s = pd.Series(values).dropna()
    smooth = s.ewm(alpha=0.3, adjust=False).mean()
    expected = smooth.iloc[-1] + 2.0 * (s - smooth).std(ddof=1) * np.array([1, 2])
    p = dataclasses.replace(RISK, method="ewma")
    levels = series(spark, values, column="target_level").unionByName(
        series(spark, [5.0], entity="short", column="target_level"))
    rows = risk.thresholds(levels, p, "log1p").orderBy("tier_index").collect()
    assert [r["value_log"] for r in rows] == pytest.approx(list(expected))


def test_upper_bound_decides_and_ties_stay_mild(spark):
    f = _forecasts(spark, [("a", 1.0, 0.5, 3.0), ("b", 1.0, 0.5, 2.0), ("c", 0.1, 0.0, 0.2)])
    b = _bounds(spark, [("a", 1, 1.5), ("a", 2, 2.5), ("b", 1, 2.0), ("b", 2, 2.0),
                        ("c", 1, 1.0), ("c", 2, 2.0)])
    tiers = {r["entity"]: r["tier"] for r in risk.recommend(f, b, RISK, "log1p").collect()}
    assert tiers == {"a": "HIGH", "b": "MEDIUM", "c": "LOW"}
    point = dataclasses.replace(RISK, alert_on="point")
    assert {r["tier"] for r in risk.recommend(f, b, point, "log1p").collect()} == {"LOW"}


def test_missing_thresholds_or_columns_are_errors(spark):
    f = _forecasts(spark, [("a", 1.0, 0.5, 3.0)])
    with pytest.raises(Exception, match="no thresholds for a"):
        risk.recommend(f, _bounds(spark, [("z", 1, 1.0)]), RISK, "log1p").collect()
    with pytest.raises(ContractError):
        risk.recommend(f.drop("upper_log"), _bounds(spark, [("a", 1, 1.0)]), RISK, "log1p")


def test_sentences_and_drivers(spark):
    f = _forecasts(spark, [("a", 1.0, 0.5, 3.0), ("b", 0.1, 0.0, 0.2)])
    b = _bounds(spark, [("a", 1, 1.5), ("a", 2, 2.5), ("b", 1, 1.0), ("b", 2, 2.0)])
    drivers = spark.createDataFrame(
        [("a", D, [("rain lag-3", 0.4), ("x", 0.2), ("y", 0.1)])],
        "entity string, origin_date date, drivers array<struct<label:string,value:double>>")
    rows = risk.render_all(risk.recommend(f, b, RISK, "log1p", drivers=drivers)).collect()
    assert rows[0]["sentence"] == (
        "HIGH - predicted 1.7 cases per 100k (80% interval upper bound 19.1), above the label of "
        "11.2 for a (n=36). Top drivers: rain lag-3, x. Actions: Escalate to the duty lead; "
        "Report daily until the alert clears.")
    assert rows[1]["sentence"].startswith("LOW - predicted 0.1") and (
        "below the lowest threshold for b." in rows[1]["sentence"])


def test_summary_lists_every_tier(spark):
    f = _forecasts(spark, [("a", 1.0, 0.5, 3.0)])
    b = _bounds(spark, [("a", 1, 1.5), ("a", 2, 2.5)])
    rows = risk.alert_summary(risk.recommend(f, b, RISK, "log1p"), RISK).orderBy(
        "tier_index").collect()
    assert [r["count"] for r in rows] == [0, 0, 1] and rows[2]["ratio"] == pytest.approx(10.0)


def test_watchlist_ranks_by_relative_exceedance(spark):
    f = _forecasts(spark, [("k", 1.0, 0.5, np.log1p(10.0)), ("o", 1.0, 0.5, np.log1p(3.0)),
                           ("p", 1.0, 0.5, np.log1p(1.0))])
    b = _bounds(spark, [("k", 2, np.log1p(9.0)), ("o", 2, np.log1p(1.0)), ("p", 2, np.log1p(2.0))])
    rows = serving.watchlist(f, b, "HIGH", date(2020, 2, 1)).collect()
    assert [r["entity"] for r in rows] == ["o", "k"]
    assert rows[0]["exceedance"] == pytest.approx(2.0)


def test_as_of_and_bands(spark):
    f = _forecasts(spark, [("a", 1.0, 0.5, 2.0), ("b", 1.0, 0.5, 3.0)])
    newer = f.where("entity = 'a'").withColumns(
        {"target_date": F.lit(date(2020, 6, 1)), "origin_date": F.lit(date(2020, 5, 1))})
    both = f.unionByName(newer)
    asof = {r["entity"]: r["target_date"] for r in serving.at_period(both, date(2020, 3, 1)
                                                                     ).collect()}
    assert asof == {"a": date(2020, 2, 1), "b": date(2020, 2, 1)}
    assert {r["target_date"] for r in serving.at_period(both, date(2019, 1, 1)).collect()} == {
        date(2020, 6, 1), date(2020, 2, 1)}
    assert serving.with_bands(f.limit(0)).count() == 0
    edges = F.array(*map(F.lit, [1.0, 10.0, 20.0, 30.0]))
    bands = f.select(serving.band_of(F.col("upper_rate"), edges)).collect()
    assert [r[0] for r in bands] == [1, 2]


def test_missing_level_stays_missing(spark):
    df = spark.createDataFrame([(None,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(inverse_target(F.col("x"), "log1p")).collect()]
    assert got == [None, 0.0]


# -- scenarios ----------------------------------------------------------------


def test_zero_change_is_the_panel_and_spikes_survive(spark):
    panel = series(spark, [1, 1, 1, 1, 1, 1, 1, 1, 1, 900, None])
    s = Scenario("cases", 0.0)
    got = whatif.apply_scenario(panel, s, ClampParams("sigma", 2.0)).orderBy("period").collect()
    assert [r["cases"] for r in got] == [r["cases"] for r in panel.orderBy("period").collect()]
    assert not any(r["clamped"] for r in got) and all(r["touched"] for r in got)


def test_change_is_clamped_to_the_own_range(spark):
    panel = series(spark, [10, 20, 30])
    got = whatif.apply_scenario(panel, Scenario("cases", 100.0), ClampParams("minmax"))
    rows = got.orderBy("period").collect()
    assert [r["cases"] for r in rows] == [20.0, 30.0, 30.0]
    counts = whatif.scenario_counts(got).first()
    assert (counts["n_touched"], counts["n_clamped"]) == (3, 2)


def test_scenario_that_selects_nothing(spark):
    with pytest.raises(ParamError):
        whatif.what_if(series(spark, [1.0]), Scenario("cases", 1.0, entities=("zz",)), None,
                       ClampParams())
    with pytest.raises(ParamError):
        whatif.apply_scenario(series(spark, [1.0]), Scenario("nope", 1.0), ClampParams())


# -- projections --------------------------------------------------------------


@pytest.mark.parametrize("steps, damping, low, high", [
    (24, 1.0, 24, 24), (24, 0.9, 0.1, 9.999), (24, 0.0, 0, 0), (0, 0.9, 0, 0)])
def test_damping(spark, steps, damping, low, high):
    got = spark.range(1).select(damped_steps(F.lit(steps), damping)).first()[0]
    assert low <= got <= high


def _levels(spark, values, entity="a"):
    return series(spark, values, entity=entity, column="target_level", n0=2010)


def test_seasonal_profile_repeats_the_wave_and_brackets_it(spark):
    wave = [2 + np.sin(2 * np.pi * i / 12) for i in range(60)]
    req = spark.createDataFrame([("a", date(2015, 3, 1)), ("a", date(2016, 12, 1)),
                                 ("a", date(2030, 3, 1))], "entity string, target_date date")
    rows = seasonal.project_seasonal(_levels(spark, wave), req, calendar(60), SeasonalParams(),
                                     0.2, "log1p").orderBy("target_date").collect()
    for r, i in zip(rows, (2, 11, 2)):
        assert r["predicted_rate"] == pytest.approx(np.expm1(wave[i]))
        assert r["lower_rate"] <= r["predicted_rate"] <= r["upper_rate"]
    assert [r["periods_ahead"] for r in rows] == [3, 24, 183]
    assert [r["anchored"] for r in rows] == [True, True, False]


def test_trend_is_dropped_beyond_the_edge(spark):
    rising = [1 + 0.01 * i for i in range(60)]
    req = spark.createDataFrame([("a", date(2015, 1, 1)), ("a", date(2030, 1, 1))],
                                "entity string, target_date date")
    near, far = seasonal.project_seasonal(
        _levels(spark, rising), req, calendar(60), SeasonalParams(), 0.2, "log1p"
    ).orderBy("target_date").collect()
    assert near["trend_shift"] > 0 and far["trend_shift"] == 0
    assert near["predicted_rate"] > far["predicted_rate"]


def test_typical_year_lists_unseen_positions(spark):
    rows = seasonal.climatology_year(_levels(spark, [1.0, 2.0, 3.0]), calendar(12),
                                     SeasonalParams(), 0.2, "none").orderBy("position").collect()
    assert len(rows) == 12 and rows[0]["label"] == "Jan" and rows[11]["observed"] == 0
    assert rows[11]["predicted"] == pytest.approx(2.0)


def test_reach_classes(spark):
    panel = series(spark, [3.0] * 24 + [None] * 3, n0=2010).withColumn("population", F.lit(1e5))
    asked = [date(2009, 1, 9), date(2011, 5, 20), date(2012, 2, 1), date(2012, 12, 1),
             date(2015, 1, 1), date(2060, 1, 1)]
    req = spark.createDataFrame([("a", x) for x in asked], "entity string, asked date")
    rows = project.classify_targets(panel, req, TARGET, calendar(27), 1, ProjectionParams(),
                                    SeasonalParams()).orderBy("target_date").collect()
    assert [r["reach"] for r in rows] == ["before_data", "historical", "forecastable", "seasonal",
                                          "climatology", "beyond_reach"]
    assert rows[1]["observed_rate"] == pytest.approx(3.0) and rows[1]["steps_ahead"] == -7
    assert rows[2]["steps_ahead"] == 2 and rows[2]["observed_rate"] is None


def test_extension_uses_normals_then_the_mean_and_no_duplicates(spark):
    panel = series(spark, [1.0, 2.0, 3.0], n0=2010)
    out = project.extend_panel(panel, ["cases"], 11, calendar(3)).orderBy("period").collect()
    assert len(out) == 14 and len({r["period"] for r in out}) == 14
    assert out[3]["cases"] == 2.0          # April was never seen: the entity mean
    assert out[12]["cases"] == 1.0         # the next January


# -- production ---------------------------------------------------------------

P = FeatureParams(level_variables=("rainfall",), include_lags=False, lags=(12,),
                  sequence_length=2)


@pytest.fixture(scope="module")
def model(spark):
    panel = wave_panel(spark, ("a", "b"), 84).cache()
    setting = Setting(TARGET, calendar(84))
    return panel, production.train_production(panel, P, 1, setting, "ridge",
                                              entities=["a", "b"])


def test_stored_model_scores_the_same(spark, model, tmp_path):
    panel, m = model
    production.save_production(m, str(tmp_path / "m"))
    again = production.load_production(spark, str(tmp_path / "m"))
    key = lambda df: [tuple(r) for r in df.orderBy("entity", "origin_date").collect()]
    assert key(again.predict(panel)) == key(m.predict(panel))
    assert again.columns_from("rainfall") == ["rainfall"]


def test_curve_covers_every_period_and_widens(model):
    panel, m = model
    variables = ["cases", "rainfall", "population"]
    p = ProjectionParams(max_recursive_steps=3)
    rows = project.project_recursive(panel.select("entity", "period", *variables), variables, m,
                                     TARGET, calendar(84), ClampParams(), p).orderBy(
        "entity", "target_date").collect()
    a = [r for r in rows if r["entity"] == "a"]
    assert [r["steps_ahead"] for r in a] == [1, 2, 3, 4]
    assert [r["mode"] for r in a] == ["direct"] + ["recursive"] * 3
    assert [r["reliability"] for r in a] == pytest.approx([1.0, 0.75, 0.5, 0.25])
    assert all(r["lower_rate"] <= r["predicted_rate"] <= r["upper_rate"] for r in a)


def test_zero_scenario_forecasts_the_baseline(model):
    panel, m = model
    deltas, counts = whatif.what_if(panel, Scenario("rainfall", 0.0), m, ClampParams())
    r = whatif.what_if_summary(deltas, counts, True).first()
    assert (r["mean_delta"], r["max_delta"], r["n_clamped"]) == (0.0, 0.0, 0)


def test_ablation_records_skips(spark, model):
    panel, _ = model
    from panelcore.params import FoldParams

    setting = Setting(TARGET, calendar(84), FoldParams(2, 36, 12, 12))
    grid = [Experiment("base"), Experiment("no_history", {"include_target_lags": False})]
    table, skipped = production.ablation_grid(
        panel, P, grid, [1], setting, ["persistence", "seasonal_trend"], entities=["a", "b"])
    assert {(r["experiment"], r["model"]) for r in table.collect()} == {
        ("base", "persistence"), ("base", "seasonal_trend")}
    assert {tuple(s)[:2] for s in skipped.collect()} == {("no_history", "persistence"),
                                        ("no_history", "seasonal_trend")}


def test_smallest_configuration_within_one_std(spark):
    schema = ("experiment string, model string, horizon int, n_features int, mae_rate double, "
              "mae_rate_std double")
    table = spark.createDataFrame(
        [("complex", "m", 1, 72, 0.0265, 0.0028), ("simple", "m", 1, 29, 0.0280, 0.0043),
         ("other", "n", 1, 2, 0.01, 0.001)], schema)
    assert tuple(evaluate.select_configuration(table, "m").first()) == ("simple", 1)
    assert tuple(evaluate.select_configuration(table, "m", parsimony=False).first()) == (
        "complex", 1)
    sig = {r["experiment"]: r for r in evaluate.significance(table).collect()}
    assert sig["simple"]["gap_in_std"] == pytest.approx(0.0015 / 0.0043)
    assert not sig["simple"]["distinguishable"]

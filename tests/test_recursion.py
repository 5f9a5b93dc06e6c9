"""The recursion inside rows against step-by-step rescoring of the same model."""

import pytest
from conftest import TARGET, calendar, wave_panel
from pyspark.sql import functions as F

from panelcore.operators import project, recursion
from panelcore.operators.whatif import plausible_range
from panelcore.params import ClampParams, FeatureParams, FoldParams, ProjectionParams
from panelcore.plans.production import Setting, train_production

N = 84
VARIABLES = ["cases", "rainfall", "population"]
STEPS = ProjectionParams(max_recursive_steps=4)
LAGS = FeatureParams(
    level_variables=("cases", "rainfall"), lags=(1, 12), lag_variables=("cases", "rainfall"),
    windows=(3,), rolling_variables=("cases", "rainfall"), rolling_aggs=("mean", "sum"),
    sequence_length=2)
SPATIAL = FeatureParams(include_lags=False, lags=(12,), include_spatial=True, spatial_lags=(1, 2),
                        spatial_variable="cases", sequence_length=2, entity_identity=False)
EXTREME = FeatureParams(lags=(1, 12), windows=(3,), rolling_variables=("cases",),
                        rolling_aggs=("max",), sequence_length=1)


@pytest.fixture(scope="module")
def panel(spark):
    rows = wave_panel(spark, ("a", "b", "c"), N, trend=0.002).select("entity", "period", *VARIABLES)
    stale = (F.col("entity") == "b") & (F.col("period") > F.add_months(F.lit("2010-01-01"), N - 14))
    return rows.withColumn("cases", F.when(~stale, F.col("cases"))).cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("a", "c"),
                                  ("c", "a")],
                                 "entity string, neighbour string")


def trained(panel, p, name, edges=None, horizon=1):
    s = Setting(TARGET, calendar(N), FoldParams(2, 36, 12, 12))
    return train_production(panel, p, horizon, s, name, edges=edges, entities=["a", "b", "c"])


def both_ways(panel, m):
    clamp = ClampParams()
    form = recursion.linear_form(m.fitted.inner, m.spec, TARGET.target)
    assert form is not None
    got = project.project_recursive(panel, VARIABLES, m, TARGET, calendar(N), clamp, STEPS)
    bounds = plausible_range(panel, TARGET.target, clamp)
    want = project._curve(project._rescored(panel, VARIABLES, m, TARGET, calendar(N), bounds, STEPS),
                          STEPS)
    return [sorted(map(tuple, x.collect())) for x in (got, want)]


@pytest.mark.parametrize("name,p,horizon", [
    ("persistence", LAGS, 1), ("seasonal_naive", LAGS, 3), ("ridge", LAGS, 1), ("ridge", LAGS, 2),
    ("ridge", SPATIAL, 1)])
def test_same_curve_as_rescoring(panel, edges, name, p, horizon):
    m = trained(panel, p, name, edges if p.include_spatial else None, horizon)
    got, want = both_ways(panel, m)
    assert len(got) == len(want) == 3 * (horizon + STEPS.max_recursive_steps)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[6] == b[6]
        assert a[3:6] == pytest.approx(b[3:6]) and a[7] == pytest.approx(b[7])


def test_one_job_and_no_checkpoint_for_a_column_pick(spark, panel, monkeypatch):
    m = trained(panel, LAGS, "persistence")
    monkeypatch.setattr(project, "cut_lineage", None)
    monkeypatch.setattr(recursion, "cut_lineage", None)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("recursion", "")
    rows = project.project_recursive(panel, VARIABLES, m, TARGET, calendar(N), ClampParams(), STEPS)
    assert not tracker.getJobIdsForGroup("recursion")  # building the plan runs nothing
    assert rows.count() == 15 and len(tracker.getJobIdsForGroup("recursion")) < 30
    spark.sparkContext.setJobGroup("tests", "")


def test_what_is_not_linear_is_rescored(panel):
    m = trained(panel, EXTREME, "ridge")
    assert recursion.linear_form(m.fitted.inner, m.spec, TARGET.target) is None
    rows = project.project_recursive(panel, VARIABLES, m, TARGET, calendar(N), ClampParams(), STEPS)
    assert rows.count() == 15


def test_asked_periods_are_cut_at_the_cap(spark, panel):
    m = trained(panel, LAGS, "persistence")
    ends = {r.entity: r.last_observed for r in project.last_observed(panel, "cases").collect()}
    asked = spark.createDataFrame(
        [(e, str(d)) for e, d in ends.items()], "entity string, d string").select(
        "entity", F.explode(F.array(*[F.add_months("d", k) for k in (-3, 2, 60)])).alias("asked"))
    asked = asked.union(asked).union(spark.sql("select 'nobody', date'2020-01-01'"))
    rows = project.project_to(panel, asked, VARIABLES, m, TARGET, calendar(N), ClampParams(), STEPS)
    seen = {}
    for r in rows.collect():
        seen.setdefault((r.entity, r.truncated), []).append(r.steps_ahead)
    assert {k: sorted(v) for k, v in seen.items()} == {
        **{(e, False): [1, 2] for e in "abc"}, **{(e, True): [1, 2, 3, 4, 5] for e in "abc"}}


def test_a_gap_ends_the_curve_and_an_unseen_entity_has_none(spark, panel):
    late = F.col("period") == F.add_months(F.lit("2010-01-01"), N - 12)
    holes = panel.withColumn("cases", F.when(~((F.col("entity") == "a") & late), F.col("cases")))
    never = panel.where("entity = 'c'").withColumn("entity", F.lit("z")).withColumn(
        "cases", F.lit(None).cast("double"))
    m = trained(panel, LAGS, "persistence")
    got, want = both_ways(holes.unionByName(never), m)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert {r[0] for r in got} >= {"b", "c"} and "z" not in {r[0] for r in got}

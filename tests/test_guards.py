import pytest
from conftest import series

from panelcore import checks
from panelcore.operators.intervals import conformalise
from panelcore.operators.models import FittedModel
from panelcore.params import (
    Calendar,
    ConformalParams,
    FoldParams,
    ParamError,
    RiskParams,
    Scenario,
)
from panelcore.session import RUNTIME, scratch_path, tune
from datetime import date
from pyspark.sql import functions as F


def test_columns_must_match_in_order():
    checks.require_same_columns(["a", "b"], ["a", "b"], 3, 3)
    for actual, steps in ((["b", "a"], 3), (["a"], 3), (["a", "b"], 2)):
        with pytest.raises(checks.ContractError):
            checks.require_same_columns(["a", "b"], actual, 3, steps)


def test_non_finite_values_are_counted(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "p double")
    with pytest.raises(checks.ContractError, match="3 non-finite"):
        checks.require_finite(df, "p")
    checks.require_finite(df.where("p = 1"), "p")


def test_every_fold_needs_its_three_roles(spark):
    schema = "fold int, role string, n long"
    full = [(0, r, 5) for r in ("fit", "val", "test")]
    checks.require_usable(spark.createDataFrame(full, schema))
    with pytest.raises(checks.ContractError, match="1"):
        checks.require_usable(spark.createDataFrame(full + [(1, "fit", 5), (1, "val", 2)], schema))


def test_panel_columns_must_be_numeric(spark):
    checks.require_panel(series(spark, [1.0]))
    with pytest.raises(checks.ContractError):
        checks.require_panel(series(spark, [1.0]).withColumn("note", F.lit("x")))


def test_wrapping_needs_enough_residuals(spark):
    class Zero(FittedModel):
        def transform(self, samples):
            return samples.withColumn("prediction", F.lit(0.0))

    few = spark.createDataFrame([(float(i),) for i in range(5)], "y double")
    with pytest.raises(checks.ContractError, match="only 5"):
        conformalise(Zero(), few, ConformalParams())
    many = spark.createDataFrame([(float(i),) for i in range(40)], "y double")
    row = conformalise(Zero(), many, ConformalParams()).transform(many).first()
    assert row["upper"] - row["prediction"] == pytest.approx(row["prediction"] - row["lower"])


@pytest.mark.parametrize("build", [
    lambda: Calendar(date(2020, 2, 1), date(2020, 1, 1)),
    lambda: Calendar(date(2020, 1, 1), date(2020, 2, 1), "daily"),
    lambda: FoldParams(n_folds=1),
    lambda: RiskParams(quantiles=(0.9, 0.75)),
    lambda: RiskParams(tiers=("LOW", "HIGH")),
    lambda: RiskParams(actions={"LOW": ("x",)}),
    lambda: Scenario("x", 1.0, mode="factor"),
    lambda: FoldParams(test_size=2).check_horizons([1, 3]),
])
def test_parameter_rules(build):
    with pytest.raises(ParamError):
        build()


def test_session_helpers(spark):
    tune(spark)
    assert all(spark.conf.get(k) == v for k, v in RUNTIME.items())
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_sums_survive_a_hot_entity(spark):
    """One entity holds most facts; results do not depend on it."""
    from panelcore.operators.panel import entity_facts, period_facts

    cal = Calendar(date(2020, 1, 1), date(2020, 3, 31))
    facts = spark.range(3000).select(
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).alias("k"),
        F.expr("timestamp'2020-01-15 10:00:00' + make_interval(0, 0, 0, cast(id % 60 as int))"
               ).alias("ts"),
        (F.col("id") % 7).cast("double").alias("v"))
    members = spark.range(50).select(F.col("id").alias("m"),
                                     (F.col("id") % 3).cast("string").alias("entity"))
    partial = period_facts(facts, "k", F.col("ts"), "v", cal)
    assert partial.where("k = 0").count() <= 3
    got = {(r["entity"], r["period"]): (r["n"], r["mean"], r["top"])
           for r in entity_facts(partial, members, "k", "m").collect()}
    plain = {(r["entity"], r["period"]): (r["n"], r["mean"], r["top"]) for r in
             facts.join(members, facts.k == members.m)
             .groupBy("entity", F.trunc("ts", "month").alias("period"))
             .agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"),
                  F.max("v").alias("top")).collect()}
    assert got.keys() == plain.keys()
    assert all(got[k] == pytest.approx(plain[k]) for k in got)


def test_reversed_spans_and_unknown_tiers_are_refused():
    from datetime import date

    from panelcore.params import RiskParams, Scenario

    with pytest.raises(ParamError, match="before it starts"):
        Scenario("x", 1.0, start=date(2000, 2, 1), end=date(2000, 1, 1))
    with pytest.raises(ParamError, match="unknown tiers"):
        RiskParams(actions={"LOW": ("a",), "MEDIUM": ("b",), "HIGH": ("c",), "EXTREME": ("d",)})


def test_a_hole_or_a_repeated_period_fails_the_job_that_trains(spark):
    from conftest import TARGET, calendar, wave_panel

    from panelcore.operators import features
    from panelcore.params import FeatureParams

    panel = wave_panel(spark, ("a", "b"), 36)
    p = FeatureParams(level_variables=("rainfall",), include_lags=False, lags=(12,), sequence_length=1,
                      entity_identity=False)
    built = lambda df: features.build_samples(df, p, TARGET, calendar(36), 1)[0]
    assert built(panel).count() > 0
    hole = panel.where("not (entity = 'b' and period = date'2011-03-01')")
    twice = panel.union(panel.where("entity = 'a' and period = date'2011-03-01'"))
    for odd in (hole, twice):
        with pytest.raises(Exception, match="the grid is not complete"):
            built(odd).collect()


def test_a_prediction_that_is_not_finite_fails_the_job_that_reads_it(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "prediction double")
    checked = df.withColumn("prediction", checks.finite_or_fail("prediction"))
    assert checked.where("prediction is not null").limit(0).count() == 0
    with pytest.raises(Exception, match="prediction is not finite"):
        checked.collect()


def test_two_national_values_in_one_period_fail(spark):
    from panelcore.sources import readers

    grid = spark.sql("select 'a' as entity, date'2020-01-01' as period")
    one = spark.sql("select date'2020-01-01' as period, 'v' as variable, 1.0D as value")
    assert readers.broadcast_series(one, grid).count() == 1
    with pytest.raises(Exception, match="several national values"):
        readers.broadcast_series(one.union(one), grid).collect()


def test_dated_files_are_read_by_line_however_they_are_split(spark, tmp_path):
    from panelcore.sources import readers

    lines = "".join(f"name {i},{i}\n" for i in range(3000))
    (tmp_path / "2020-01.csv").write_text("Category: All\n\nregion,interest\n" + lines)
    folder = tmp_path / "p=2020-02"
    folder.mkdir()
    (folder / "part-0.csv").write_text("Category: All\n\nregion,interest\nname 1,<1\n\nname 2,5\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        big = readers.read_dated_files(spark, str(tmp_path / "2020-01.csv"), "v")
        assert big.rdd.getNumPartitions() > 3
        rows = {r.entity: (str(r.period), r.value) for r in big.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {f"name {i}": ("2020-01-01", float(i)) for i in range(3000)}
    small = readers.read_dated_files(spark, str(folder / "*.csv"), "v").collect()
    assert sorted((r.entity, str(r.period), r.value) for r in small) == [
        ("name 1", "2020-02-01", None), ("name 2", "2020-02-01", 5.0)]


from datetime import date

import pytest

from panelcore.checks import ContractError, check_long, require_single_owner
from panelcore.params import Calendar
from panelcore.sources import anchors, cells, conform, readers, registry, runs

LONG = "entity string, period date, variable string, value double"
CAL = Calendar(date(2015, 1, 1), date(2015, 12, 31))


def test_long_table_by_role(spark, tmp_path):
    p = tmp_path / "cases.csv"
    p.write_text(" State ,MONTH,Cases\nOrissa,2015-01-15,10\nKerala,2015-02-28,\n,2015-03-01,4\n"
                 "Kerala,,5\nKerala,2015-04-01,n/a\n")
    raw = readers.read_long(spark, str(p), "cases")
    names = spark.createDataFrame([("Odisha",), ("Kerala",)], "canonical string")
    aliases = spark.createDataFrame([("Orissa", "Odisha")], "alias string, canonical string")
    out = conform.conform(raw, CAL, ["cases"], registry.registry_table(names, aliases))
    rows = {(r["entity"], r["period"]): r["value"] for r in out.collect()}
    assert rows == {("Odisha", date(2015, 1, 1)): 10.0, ("Kerala", date(2015, 2, 1)): None,
                    ("Kerala", date(2015, 4, 1)): None}


def test_wide_table_and_bad_header(spark, tmp_path):
    good, bad = tmp_path / "wide.csv", tmp_path / "bad.csv"
    good.write_text("state,2015-01,Feb 2015\nx,1,2\ny,,4\n")
    bad.write_text("state,2015-01,notes\nx,1,2\n")
    rows = readers.read_long(spark, str(good), "cases").collect()
    assert {(r["entity"], r["period"], r["value"]) for r in rows} == {
        ("x", "2015-01-01", 1.0), ("x", "2015-02-01", 2.0), ("y", "2015-01-01", None),
        ("y", "2015-02-01", 4.0)}
    with pytest.raises(ContractError, match="not dates"):
        readers.read_long(spark, str(bad), "cases")


def test_dated_files(spark, tmp_path):
    for m, v in (("2019-07", 5), ("2019-08", 9)):
        (tmp_path / f"{m}.csv").write_text(f"Category: All\n\nregion,interest\nx,{v}\ny,<1\n")
    rows = readers.read_dated_files(spark, str(tmp_path), "interest").collect()
    assert {(r["entity"], r["period"], r["value"]) for r in rows} == {
        ("x", date(2019, 7, 1), 5.0), ("y", date(2019, 7, 1), None),
        ("x", date(2019, 8, 1), 9.0), ("y", date(2019, 8, 1), None)}


def test_dated_file_with_an_odd_name_fails(spark, tmp_path):
    (tmp_path / "latest.csv").write_text("a\n\nb\nx,1\n")
    with pytest.raises(Exception, match="file name is not a period"):
        readers.read_dated_files(spark, str(tmp_path), "interest").collect()


def test_unknown_name_and_bad_date_are_fatal(spark):
    names = registry.registry_table(spark.createDataFrame([("Kerala",)], "canonical string"))
    raw = spark.createDataFrame([("Atlantis", "2015-01-01")], "entity string, period string")
    with pytest.raises(ContractError, match="Atlantis"):
        registry.normalise_entity(raw, names)
    odd = spark.createDataFrame([("Kerala", "soon")], "entity string, period string")
    with pytest.raises(Exception, match="not a date"):
        conform.snap_period(odd, CAL).collect()


def test_weeks_snap_to_monday(spark):
    weekly = Calendar(date(2020, 1, 1), date(2020, 12, 31), "weekly")
    df = spark.createDataFrame([("2020-01-08",), ("2020-01-06",)], "period string")
    assert {r[0] for r in conform.snap_period(df, weekly).collect()} == {date(2020, 1, 6)}


@pytest.mark.parametrize("rows, message", [
    ([("a", date(2015, 1, 1), "cases", 1.0)] * 2, "duplicate"),
    ([("a", date(2015, 1, 1), "other", 1.0)], "undeclared"),
    ([(None, date(2015, 1, 1), "cases", 1.0)], "missing key"),
    ([], "no rows"),
])
def test_contract_is_enforced(spark, rows, message):
    with pytest.raises(ContractError, match=message):
        check_long(spark.createDataFrame(rows, LONG), ["cases"])


def test_a_variable_has_one_owner():
    with pytest.raises(ContractError):
        require_single_owner({"one": ("cases",), "two": ("cases", "rain")})


def test_weights_and_missing_cells(spark):
    grid = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), (None, 3, 9.0)],
                                 "entity string, cell long, population double")
    w = cells.grid_weights(grid)
    assert {r["cell"]: r["weight"] for r in w.collect()} == {1: 0.25, 2: 0.75}
    d = date(2015, 1, 1)
    values = spark.createDataFrame(
        [(1, d, 4.0), (2, d, 8.0), (1, date(2015, 2, 1), 4.0), (2, date(2015, 2, 1), None)],
        "cell long, period date, value double")
    out = {r["period"]: r["value"] for r in cells.grid_to_entity(values, w, "t").collect()}
    assert out == {d: 7.0, date(2015, 2, 1): None}
    zero = spark.createDataFrame([("a", 1, 0.0)], "entity string, cell long, population double")
    with pytest.raises(ContractError):
        cells.grid_weights(zero)


def test_humidity_replaces_dewpoint(spark):
    d = date(2015, 1, 1)
    long = spark.createDataFrame(
        [("a", d, "temperature", 293.15), ("a", d, "dewpoint", 293.15), ("a", d, "rainfall", 0.002)],
        LONG)
    out = {r["variable"]: r["value"]
           for r in cells.derive_humidity(cells.to_panel_units(long)).collect()}
    assert out == {"temperature": pytest.approx(20.0), "rainfall": pytest.approx(2.0),
                   "humidity": pytest.approx(100.0)}


def test_exposure_between_and_outside_anchors(spark):
    census = spark.createDataFrame([("a", 2000, 100.0, 10.0), ("a", 2010, 400.0, 99.0)],
                                   "entity string, year int, population double, area double")
    days = [date(1990, 1, 1), date(2000, 1, 1), date(2005, 1, 1), date(2010, 1, 1),
            date(2020, 6, 1)]
    grid = spark.createDataFrame([("a", x) for x in days], "entity string, period date")
    rows = {r["period"]: r for r in anchors.interpolate_anchors(census, grid).collect()}
    assert [rows[x]["exposure"] for x in days] == pytest.approx([100, 100, 200, 400, 400])
    assert rows[days[2]]["density"] == pytest.approx(20.0)  # area of the earliest anchor


def test_edges_are_symmetric_and_loops_fail(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")],
                                  "entity string, neighbour string")
    assert {tuple(r) for r in registry.symmetric_edges(pairs).collect()} == {
        ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    with pytest.raises(ContractError):
        registry.symmetric_edges(spark.createDataFrame([("a", "a")], pairs.schema))


def test_boundary_events_inside_the_window(spark):
    events = spark.createDataFrame(
        [(date(2014, 6, 2), "ap", ["ts"]), (date(2019, 10, 31), "jk", ["ladakh"])],
        "effective date, parent string, children array<string>")
    names = spark.createDataFrame([("ts",), ("jk",), ("kl",)], "entity string")
    hit = registry.boundary_affected(names, events, date(2010, 1, 1), date(2016, 1, 1))
    assert [r[0] for r in hit.collect()] == ["ts"]


def test_runs_round_trip(spark, tmp_path):
    root = str(tmp_path / "runs")
    df = spark.createDataFrame([("a", 1.0)], "entity string, v double")
    runs.save_run(root, "r1", {"t": df}, {"note": "x"})
    runs.save_run(root, "r2", {"t": df.withColumn("v", df.v + 1)})
    assert [r["run"] for r in runs.list_runs(spark, root).collect()] == ["r1", "r2"]
    with pytest.raises(FileExistsError):
        runs.save_run(root, "r1", {"t": df})
    runs.save_run(root, "r1", {"t": df.withColumn("v", df.v + 5)}, overwrite=True)
    assert runs.load_run(spark, root, "r1", "t").first()["v"] == 6.0
    assert runs.load_run(spark, root, "r2", "t").first()["v"] == 2.0
    with pytest.raises(FileNotFoundError):
        runs.load_run(spark, root, "r3", "t")



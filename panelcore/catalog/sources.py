"""Readers, conversions, registry, contract checks and stored runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from panelcore import checks
from panelcore.catalog.base import (
    EDGES,
    MONTHS,
    VARIABLES,
    WEEKS,
    exposure,
    monthly,
    nation_of_customer,
    nation_panel,
    neighbour_pairs,
    observed,
    pick,
    query,
    table,
)
from panelcore.operators.panel import complete_grid
from panelcore.operators.quality import melt
from panelcore.params import Calendar
from panelcore.session import scratch_path
from panelcore.sources import anchors, cells, conform, readers, registry, runs

OBSERVED_LONG = (
    "SELECT entity, period, 'orders' AS variable, "
    "CAST(round(CAST(orders AS DECIMAL(38,9)), 6) AS DOUBLE) AS value FROM "
)


@query("read_long_table", monthly(OBSERVED_LONG + "obs"))
def read_long_table(spark, d):
    path = scratch_path(spark, "long-csv")
    observed(spark, d, MONTHS).select(
        F.col("entity").alias(" State "), F.date_format("period", "yyyy-MM").alias("MONTH"),
        F.col("orders").alias("Cases"),
    ).write.option("header", True).csv(path)
    raw = readers.read_long(spark, path, "orders")
    return conform.conform(raw, MONTHS, ["orders"])


@query("unpivot_period_columns", monthly(OBSERVED_LONG + "panel"))
def unpivot_period_columns(spark, d):
    path = scratch_path(spark, "wide-csv")
    labels = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)
              if (y, m) <= (2001, 8)]
    (
        nation_panel(spark, d).withColumn("label", F.date_format("period", "yyyy-MM"))
        .groupBy(F.col("entity").alias("State/UT")).pivot("label", labels).agg(F.max("orders"))
        .write.option("header", True).csv(path)
    )
    return conform.conform(readers.read_long(spark, path, "orders"), MONTHS, ["orders"])


@query("read_dated_files", monthly(OBSERVED_LONG + "obs"))
def read_dated_files(spark, d):
    path = scratch_path(spark, "dated-csv")
    _export_per_period(spark, observed(spark, d, MONTHS), path)
    raw = readers.read_dated_files(spark, f"{path}/*/*.txt", "orders")
    return conform.conform(raw, MONTHS, ["orders"])


def _export_per_period(spark, rows, path: str) -> None:
    """One folder per period, named after it; each file starts with the two preamble lines
    and the header. Lines are written in order by the task of their period."""
    p = F.date_format("period", "yyyy-MM").alias("p")
    head = F.posexplode(F.array(*map(F.lit, ("Category: All categories", "", "region,interest"))))
    preamble = rows.select(p).distinct().select("p", head.alias("at", "value"))
    line = F.concat_ws(",", "entity", F.col("orders").cast("string"))
    body = rows.select(p, F.lit(3).alias("at"), line.alias("value"))
    (
        preamble.unionByName(body).repartition("p").sortWithinPartitions("p", "at", "value")
        .drop("at").write.partitionBy("p").text(path)
    )


@query("broadcast_series", monthly(""",
total AS (SELECT period, sum(orders) AS value FROM obs GROUP BY 1) """ + pick(
    "entity period variable ~value",
    "FROM (SELECT g.entity, g.period, 'national_orders' AS variable, t.value "
    "FROM grid g JOIN total t USING (period))")))
def broadcast_series(spark, d):
    national = observed(spark, d, MONTHS).groupBy("period").agg(
        F.lit("national_orders").alias("variable"), F.sum("orders").alias("value")
    )
    return readers.broadcast_series(national, complete_grid(exposure(spark, d), MONTHS, unique=True))


def _terms(spark, d):
    o = table(spark, d, "orders").select(
        "o_custkey", "o_orderdate", "o_totalprice", F.col("o_orderpriority").alias("term")
    )
    per_customer = o.groupBy("o_custkey", "term", F.trunc("o_orderdate", "month").alias("period")
                             ).agg(F.sum("o_totalprice").alias("v"))
    return per_customer.join(nation_of_customer(spark, d), F.col("o_custkey") == F.col("c_custkey")
                             ).groupBy("entity", "period", "term").agg(F.sum("v").alias("value"))


@query("sum_terms", """
WITH terms AS (
  SELECT n_name AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         o_orderpriority AS term, sum(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3),
s AS (SELECT entity, period, 'interest' AS variable, sum(value) AS value FROM terms GROUP BY 1, 2)
""" + pick("entity period variable ~value", "FROM s"))
def sum_terms(spark, d):
    return readers.sum_terms(_terms(spark, d), "interest")


def _customer_cells(spark, d):
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("entity"), F.col("c_custkey").alias("cell"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("population"),
    )


@query("grid_weights", """
WITH cells AS (
  SELECT n_name AS entity, c_custkey AS cell, greatest(c_acctbal, 0.0) AS population
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT entity, cell, population / sum(population) OVER (PARTITION BY entity) AS weight
      FROM cells)
""" + pick("entity cell ~weight", "FROM w"))
def grid_weights(spark, d):
    return cells.grid_weights(_customer_cells(spark, d))


def _supplier_cells(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("entity"), F.col("s_suppkey").alias("cell"),
        F.greatest("s_acctbal", F.lit(1.0)).alias("population"),
    )


@query("grid_to_entity", """
WITH cells AS (
  SELECT n_name AS entity, s_suppkey AS cell, greatest(s_acctbal, 1.0) AS population
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w AS (SELECT entity, cell, population / sum(population) OVER (PARTITION BY entity) AS weight,
             count(*) OVER (PARTITION BY entity) AS n_cells
      FROM cells),
v AS (SELECT l_suppkey AS cell, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
             avg(l_quantity) AS value
      FROM lineitem GROUP BY 1, 2),
agg AS (SELECT entity, period, 'quantity' AS variable,
               CASE WHEN count(value) = max(n_cells) THEN sum(weight * value) END AS value
        FROM v JOIN w USING (cell) GROUP BY 1, 2)
""" + pick("entity period variable ~value", "FROM agg"))
def grid_to_entity(spark, d):
    weights = cells.grid_weights(_supplier_cells(spark, d))
    cells.check_weights(weights)
    values = table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("cell"), F.trunc("l_shipdate", "month").alias("period")
    ).agg(F.avg("l_quantity").alias("value"))
    return cells.grid_to_entity(values, weights, "quantity")


def _climate_long(spark, d):
    p = observed(spark, d, MONTHS)
    return melt(p.select(
        "entity", "period",
        (F.lit(273.15) + F.col("avg_price") / 10000).alias("temperature"),
        (F.lit(273.15) + F.col("avg_price") / 10000 - F.col("orders") / 10).alias("dewpoint"),
        (F.col("max_price") / 1e6).alias("rainfall"),
    ), ["temperature", "dewpoint", "rainfall"])


CLIMATE = """,
climate AS (
  SELECT entity, period, 'temperature' AS variable, 273.15 + avg_price / 10000 AS value FROM obs
  UNION ALL SELECT entity, period, 'dewpoint', 273.15 + avg_price / 10000 - orders / 10 FROM obs
  UNION ALL SELECT entity, period, 'rainfall', max_price / 1e6 FROM obs),
units AS (
  SELECT entity, period, variable,
         CASE WHEN variable = 'rainfall' THEN value * 1000 ELSE value - 273.15 END AS value
  FROM climate)"""


@query("panel_units", monthly(CLIMATE + " " + pick("entity period variable ~value", "FROM units")))
def panel_units(spark, d):
    return cells.to_panel_units(_climate_long(spark, d))


@query("derive_humidity", monthly(CLIMATE + """,
pair AS (
  SELECT entity, period, max(value) FILTER (variable = 'temperature') AS t,
         max(value) FILTER (variable = 'dewpoint') AS dp
  FROM units GROUP BY 1, 2),
humid AS (
  SELECT entity, period, variable, value FROM units WHERE variable <> 'dewpoint'
  UNION ALL
  SELECT entity, period, 'humidity',
         100 * exp(17.625 * dp / (243.04 + dp)) / exp(17.625 * t / (243.04 + t))
  FROM pair) """ + pick("entity period variable ~value", "FROM humid")))
def derive_humidity(spark, d):
    return cells.derive_humidity(cells.to_panel_units(_climate_long(spark, d)))


@query("interpolate_anchors", monthly(""",
anchors AS (
  SELECT entity, year(period) AS yr, 1000 * sum(orders) AS population, max(exposure) AS area
  FROM panel GROUP BY 1, 2 HAVING sum(orders) > 0),
t AS (SELECT entity, period, year(period) + (dayofyear(period) - 1) / 365.25 AS t FROM grid),
near AS (
  SELECT t.entity, t.period, t.t, max(yr) FILTER (yr <= t.t) AS y0, min(yr) FILTER (yr >= t.t) AS y1,
         min(yr) AS first_year
  FROM t JOIN anchors a ON a.entity = t.entity GROUP BY 1, 2, 3),
joined AS (
  SELECT n.*, ln(a0.population) AS p0, ln(a1.population) AS p1, f.area
  FROM near n LEFT JOIN anchors a0 ON a0.entity = n.entity AND a0.yr = n.y0
  LEFT JOIN anchors a1 ON a1.entity = n.entity AND a1.yr = n.y1
  JOIN anchors f ON f.entity = n.entity AND f.yr = n.first_year),
res AS (
  SELECT entity, period, area,
         exp(CASE WHEN y0 IS NULL THEN p1 WHEN y1 IS NULL THEN p0 WHEN y0 = y1 THEN p0
             ELSE p0 + (p1 - p0) * (t - y0) / (y1 - y0) END) AS exposure
  FROM joined),
fin AS (SELECT entity, period, exposure, exposure / area AS density FROM res)
""" + pick("entity period ~exposure ~density", "FROM fin")))
def interpolate_anchors(spark, d):
    census = (
        nation_panel(spark, d).groupBy("entity", F.year("period").alias("year"))
        .agg((F.sum("orders") * 1000).alias("population"), F.max("exposure").alias("area"))
        .where("population > 0")
    )
    anchors.check_anchors(census)
    return anchors.interpolate_anchors(census, complete_grid(exposure(spark, d), MONTHS, unique=True))


@query("normalise_entity", """
SELECT n_name AS entity, count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1""")
def normalise_entity(spark, d):
    n = table(spark, d, "nation")
    names = n.select(F.col("n_name").alias("canonical"))
    aliases = n.select(F.concat(F.lit("Country & No. "), "n_nationkey").alias("alias"),
                       F.col("n_name").alias("canonical"))
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer")
    # The same nation arrives under two spellings, depending on the source system.
    spelled = F.when(F.col("o_orderpriority") == "1-URGENT",
                     F.concat(F.lit(" COUNTRY and no "), "n_nationkey")
                     ).otherwise(F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))))
    raw = (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .groupBy(spelled.alias("entity")).agg(F.sum("n").alias("n"))
    )
    named = registry.normalise_entity(raw, registry.registry_table(names, aliases))
    return named.groupBy("entity").agg(F.sum("n").alias("n_orders"))


@query("snap_period", """
SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS period, count(*) AS n_orders
FROM orders GROUP BY 1""")
def snap_period(spark, d):
    text = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"))
    daily = text.groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return conform.snap_period(daily, WEEKS).groupBy("period").agg(F.sum("n").alias("n_orders"))


@query("restrict_study", monthly(" " + pick(
    "entity period ~orders ~avg_price",
    "FROM obs WHERE period BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND entity IN "
    "(SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"
)))
def restrict_study(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    studied = n.join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("entity"))
    window = Calendar(date(1996, 1, 1), date(1999, 12, 31))
    return conform.restrict(observed(spark, d, MONTHS), studied, window).select(
        "entity", "period", "orders", "avg_price")


@query("contract_findings", """
WITH rows AS (
  SELECT n_name AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         o_orderpriority AS variable
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
keyed AS (
  SELECT concat_ws('/', entity, CAST(period AS VARCHAR), variable) AS k, variable, count(*) AS c
  FROM rows GROUP BY 1, 2),
found AS (
  SELECT 'duplicate key' AS rule, k FROM keyed WHERE c > 1
  UNION ALL SELECT 'undeclared variable', k FROM keyed
  WHERE variable NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))
SELECT rule, count(*) AS n, min(k) AS first_key, max(k) AS last_key FROM found GROUP BY 1""")
def contract_findings(spark, d):
    """Orders are counted per customer, month and priority before customers join."""
    o = table(spark, d, "orders").groupBy(
        "o_custkey", F.trunc("o_orderdate", "month").alias("period"),
        F.col("o_orderpriority").alias("variable"),
    ).agg(F.count(F.lit(1)).alias("n_rows"),
          F.count_if(F.isnan(F.col("o_totalprice").cast("double"))).alias("n_nan"))
    long = o.join(nation_of_customer(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    return checks.contract_findings(long.select("entity", "period", "variable", "n_rows", "n_nan"),
                                    ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("symmetric_edges", monthly(EDGES + " SELECT entity, neighbour FROM edges"))
def symmetric_edges(spark, d):
    return registry.symmetric_edges(neighbour_pairs(spark, d))


@query("boundary_affected", monthly(EDGES + """,
ev AS (
  SELECT n_name AS entity, CAST(arg_max(o_orderdate, (o_totalprice, o_orderkey)) AS DATE) AS effective
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1),
hit AS (SELECT entity, neighbour FROM ev JOIN pairs USING (entity)
        WHERE effective BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
          AND neighbour IS NOT NULL)
SELECT entity FROM hit UNION SELECT neighbour FROM hit"""))
def boundary_affected(spark, d):
    top = F.max(F.struct("o_totalprice", "o_orderkey", "o_orderdate"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(top.alias("t"))
    peak = o.join(nation_of_customer(spark, d), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "entity").agg(F.to_date(F.max("t")["o_orderdate"]).alias("effective"))
    events = peak.join(neighbour_pairs(spark, d), "entity").select(
        "effective", F.col("entity").alias("parent"), F.array("neighbour").alias("children"))
    names = table(spark, d, "nation").select(F.col("n_name").alias("entity"))
    return registry.boundary_affected(names, events, date(1996, 1, 1), date(1998, 12, 31))


@query("stored_run", monthly(" " + pick(
    "entity period ~orders ~avg_price ~max_price ~exposure", "FROM panel")))
def stored_run(spark, d):
    root = scratch_path(spark, "runs")
    runs.save_run(root, "first", {"panel": nation_panel(spark, d)}, {"step": "panel"})
    return runs.load_run(spark, root, "first", "panel")


@query("conform_source", monthly(
    " SELECT entity, period, variable, value FROM (" + pick(
        "entity period variable ~value",
        "FROM (SELECT entity, period, 'orders' AS variable, orders AS value FROM obs "
        "UNION ALL SELECT entity, period, 'avg_price', avg_price FROM obs "
        "UNION ALL SELECT entity, period, 'max_price', max_price FROM obs)") + ")"))
def conform_source(spark, d):
    raw = melt(observed(spark, d, MONTHS), VARIABLES).withColumn(
        "entity", F.lower("entity"))
    names = table(spark, d, "nation").select(F.col("n_name").alias("canonical"))
    return conform.conform(raw, MONTHS, VARIABLES, registry.registry_table(names))

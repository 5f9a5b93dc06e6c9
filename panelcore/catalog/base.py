"""The registry, the panels derived from the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcore.operators.features import with_level
from panelcore.operators.panel import complete_grid, entity_facts, on_grid, period_facts
from panelcore.params import Calendar, TargetParams
from panelcore.session import cut_lineage, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MONTHS = Calendar(date(1995, 1, 1), date(2001, 8, 31), "monthly")
WEEKS = Calendar(date(1994, 12, 26), date(2001, 8, 31), "weekly")
TARGET = TargetParams(target="orders", exposure="exposure")
VARIABLES = ["orders", "avg_price", "max_price"]


def query(name: str, sql: str | None = None):
    """Register a query; its doubles are rounded so that sum order does not show."""

    def register(fn):
        QUERIES[name] = lambda spark, d: present(fn(tune(spark), d))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def present(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, integers to BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c.cast("decimal(38,9)"), 6).cast("double").alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def pick(columns: str, rest: str) -> str:
    """SELECT list where ``~x`` is rounded, ``#x`` a BIGINT and ``@x`` a DATE."""

    def one(c: str) -> str:
        name = c[1:]
        if c[0] == "~":
            return f"CAST(round(CAST({name} AS DECIMAL(38,9)), 6) AS DOUBLE) AS {name}"
        if c[0] == "#":
            return f"CAST({name} AS BIGINT) AS {name}"
        if c[0] == "@":
            return f"CAST({name} AS DATE) AS {name}"
        return c

    return "SELECT " + ", ".join(map(one, columns.split())) + " " + rest


# -- panels in Spark ----------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nation_of_customer(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return named(spark, d, c, "c_nationkey").select("c_custkey", "entity")


def named(spark, d, rows: DataFrame, key: str) -> DataFrame:
    """Nation names for rows that carry a nation key."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    return rows.join(n, rows[key] == n["n_nationkey"]).drop("n_nationkey", key)


def exposure(spark, d) -> DataFrame:
    """Customers are counted per key first; the names join 25 rows."""
    people = table(spark, d, "customer").groupBy("c_nationkey").agg(
        (F.count(F.lit(1)) * F.lit(1000.0)).alias("exposure")
    )
    return named(spark, d, people, "c_nationkey").select("entity", "exposure")


def order_partials(spark, d, calendar: Calendar) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return period_facts(orders, "o_custkey", F.col("o_orderdate"), "o_totalprice", calendar)


def observed(spark, d, calendar: Calendar) -> DataFrame:
    """``entity, period, orders, avg_price, max_price`` for observed cells only."""
    keys = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    facts = entity_facts(order_partials(spark, d, calendar), keys, "o_custkey", "c_custkey")
    by_key = facts.withColumnRenamed("entity", "key")
    return named(spark, d, by_key, "key").select(
        "entity", "period", F.col("n").alias("orders"), F.col("mean").alias("avg_price"),
        F.col("top").alias("max_price"))


def nation_panel(spark, d, calendar: Calendar = MONTHS) -> DataFrame:
    """The complete nation-by-period panel with exposure."""
    grid = complete_grid(exposure(spark, d), calendar, ("exposure",), unique=True)
    return on_grid(grid, observed(spark, d, calendar)).select(
        "entity", "period", *VARIABLES, "exposure"
    )


def staged_panel(spark, d) -> DataFrame:
    """The nation panel, materialised once for jobs that read it several times."""
    return cut_lineage(nation_panel(spark, d))


def customer_panel(spark, d) -> DataFrame:
    """The complete customer-by-month panel: sparse, and as wide as the customer table."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("entity"))
    facts = entity_facts(order_partials(spark, d, MONTHS), c, "o_custkey", "c_custkey")
    seen = facts.select("entity", "period", F.col("n").alias("orders"),
                        F.col("mean").alias("avg_price"), F.col("top").alias("max_price"))
    return on_grid(complete_grid(c, MONTHS, unique=True), seen)


def nation_levels(spark, d, calendar: Calendar = MONTHS) -> DataFrame:
    return with_level(nation_panel(spark, d, calendar), TARGET)


def neighbour_pairs(spark, d) -> DataFrame:
    """Each nation and the next one of its region: one pair per nation."""
    w = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, d, "nation").select(
        F.col("n_name").alias("entity"), F.lead("n_name").over(w).alias("neighbour")
    ).where("neighbour is not null")


def nation_names(spark, d) -> list[str]:
    """The registry of nations, a dimension of fixed size."""
    return [r[0] for r in table(spark, d, "nation").select("n_name").orderBy("n_name").collect()]


# -- the same panels in SQL ---------------------------------------------------

_UNIT = {"monthly": ("month", "1 MONTH", "1995-01-01"), "weekly": ("week", "7 DAY", "1994-12-26")}


def _panel_ctes(granularity: str) -> str:
    unit, step, start = _UNIT[granularity]
    return f"""
people AS (
  SELECT n_name AS entity, 1000.0::DOUBLE * count(*) AS exposure
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
obs AS (
  SELECT n_name AS entity, CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS period,
         CAST(count(*) AS DOUBLE) AS orders, avg(o_totalprice) AS avg_price,
         max(o_totalprice) AS max_price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2),
grid AS (
  SELECT entity, CAST(unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '2001-08-31',
                                             INTERVAL {step})) AS DATE) AS period
  FROM people),
panel AS (
  SELECT g.entity, g.period, o.orders, o.avg_price, o.max_price, p.exposure
  FROM grid g LEFT JOIN obs o USING (entity, period) JOIN people p USING (entity)),
levels AS (SELECT *, ln(1 + orders / exposure * 100000) AS target_level FROM panel)"""


_CUSTOMER = """
grid AS (
  SELECT c_custkey, c_name AS entity,
         CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-31',
                                     INTERVAL 1 MONTH)) AS DATE) AS period
  FROM customer),
obs AS (
  SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         CAST(count(*) AS DOUBLE) AS orders, avg(o_totalprice) AS avg_price,
         max(o_totalprice) AS max_price
  FROM orders GROUP BY 1, 2),
panel AS (
  SELECT g.entity, g.period, o.orders, o.avg_price, o.max_price
  FROM grid g LEFT JOIN obs o ON g.c_custkey = o.o_custkey AND g.period = o.period)"""


def monthly(body: str) -> str:
    return "WITH RECURSIVE " + _panel_ctes("monthly") + body


def weekly(body: str) -> str:
    return "WITH RECURSIVE " + _panel_ctes("weekly") + body


def customers(body: str) -> str:
    return "WITH " + _CUSTOMER + body


#: ``long``: the panel's variables as rows, missing cells included.
LONG = """,
long AS (
  SELECT entity, period, 'orders' AS variable, orders AS value FROM panel
  UNION ALL SELECT entity, period, 'avg_price', avg_price FROM panel
  UNION ALL SELECT entity, period, 'max_price', max_price FROM panel)"""

#: ``flags``: long rows with their outlier flag.
FLAGS = LONG + """,
med AS (SELECT entity, variable, quantile_cont(value, 0.5) AS m FROM long GROUP BY 1, 2),
dev AS (SELECT l.*, abs(l.value - m) AS d FROM long l JOIN med USING (entity, variable)),
spread AS (
  SELECT entity, variable, 1.4826 * quantile_cont(d, 0.5) AS s1, 1.2533 * avg(d) AS s2
  FROM dev GROUP BY 1, 2),
flags AS (
  SELECT entity, period, variable, value,
         coalesce(d / CASE WHEN s1 > 0 THEN s1 WHEN s2 > 0 THEN s2 END > 5.0, false)
           AS is_outlier
  FROM dev JOIN spread USING (entity, variable))"""

#: ``runs``: every run of missing values of the long rows.
RUNS = """,
seen AS (
  SELECT *, count(value) OVER (PARTITION BY entity, variable ORDER BY period
                               ROWS UNBOUNDED PRECEDING) AS k
  FROM long),
runs AS (
  SELECT entity, variable, min(period) AS start, max(period) AS "end", count(*) AS gap_length
  FROM seen WHERE value IS NULL GROUP BY entity, variable, k)"""

#: ``edges``: symmetric neighbourhood, the next nation of the same region.
EDGES = """,
pairs AS (
  SELECT n_name AS entity, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)
           AS neighbour
  FROM nation),
edges AS (
  SELECT entity, neighbour FROM pairs WHERE neighbour IS NOT NULL
  UNION SELECT neighbour, entity FROM pairs WHERE neighbour IS NOT NULL)"""

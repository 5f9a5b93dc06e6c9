"""The complete grid and the fused panel."""

from __future__ import annotations

from panelcore.catalog.base import (
    MONTHS,
    VARIABLES,
    WEEKS,
    customer_panel,
    customers,
    exposure,
    monthly,
    nation_panel,
    observed,
    pick,
    query,
    weekly,
)
from panelcore.operators.panel import complete_grid, fuse
from panelcore.operators.quality import melt


@query("complete_grid_months", monthly(" SELECT entity, period FROM grid"))
def complete_grid_months(spark, d):
    return complete_grid(exposure(spark, d), MONTHS, unique=True)


@query("complete_grid_weeks", weekly(" SELECT entity, period FROM grid"))
def complete_grid_weeks(spark, d):
    return complete_grid(exposure(spark, d), WEEKS, unique=True)


@query("fuse_sources", monthly(" " + pick(
    "entity period ~orders ~avg_price ~max_price", "FROM panel")))
def fuse_sources(spark, d):
    seen = observed(spark, d, MONTHS)
    sources = [melt(seen, ["orders"]), melt(seen, ["avg_price", "max_price"])]
    return fuse(sources, VARIABLES, complete_grid(exposure(spark, d), MONTHS, unique=True))


@query("nation_month_panel", monthly(" " + pick(
    "entity period ~orders ~avg_price ~max_price ~exposure", "FROM panel")))
def nation_month_panel(spark, d):
    return nation_panel(spark, d)


@query("nation_week_panel", weekly(" " + pick(
    "entity period ~orders ~avg_price ~max_price ~exposure", "FROM panel")))
def nation_week_panel(spark, d):
    return nation_panel(spark, d, WEEKS)


@query("customer_month_panel", customers(" " + pick(
    "entity period ~orders ~avg_price ~max_price", "FROM panel")))
def customer_month_panel(spark, d):
    return customer_panel(spark, d)

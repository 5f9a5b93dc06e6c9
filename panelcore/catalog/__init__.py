"""Registered queries: one per operator, each with the SQL it must agree with."""

from importlib import import_module

SECTIONS = ("sources", "panel", "quality", "features", "evaluation", "intervals", "risk",
            "scenario", "projection", "serving", "attribution")


def load():
    """Import every section; returns the queries and their SQL."""
    for name in SECTIONS:
        import_module(f"{__name__}.{name}")
    base = import_module(f"{__name__}.base")
    return base.QUERIES, base.ORACLES

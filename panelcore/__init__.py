"""Panel analytics on Spark: entity-by-period data from sources to decisions."""

__version__ = "0.1.0"

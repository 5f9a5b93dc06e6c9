"""Readers and conversions that end in long rows: entity, period, variable, value."""

"""Operators: lazy functions from DataFrame to DataFrame."""

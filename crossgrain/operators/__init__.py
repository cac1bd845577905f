"""Operators on panels: DataFrames keyed by (date, code)."""

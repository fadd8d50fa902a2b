"""Operators: each takes Columns or DataFrames and returns the same."""

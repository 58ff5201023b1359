"""Operators on DataFrames; each takes the names of its columns."""

"""Operators on DataFrames of any table: columns are parameters."""

"""Operators on keyed streams and changelog tables, each a function from DataFrames to a DataFrame."""

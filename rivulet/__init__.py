"""Keyed event streams and changelog tables on PySpark DataFrames."""

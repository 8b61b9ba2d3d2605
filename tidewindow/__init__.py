"""Windowed time-series analytics on Spark DataFrames."""

"""Interval analytics on Spark DataFrames."""

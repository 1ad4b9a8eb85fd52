"""Procurement-style analytics on Spark: DataFrames in, DataFrames out."""

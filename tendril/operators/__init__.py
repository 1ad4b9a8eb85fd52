"""Operators: DataFrames in, DataFrames out; ``as_of`` is always given."""

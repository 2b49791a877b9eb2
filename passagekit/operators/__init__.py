"""Operators: DataFrames in, DataFrames out; queries are rows, so all of them take batches."""

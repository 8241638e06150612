"""Operators: DataFrames in, DataFrames out, for all keys at once. None collects."""

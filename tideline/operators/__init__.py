"""Operators: pure functions from DataFrames to DataFrames, built of columns, windows and joins."""

"""Operators on DataFrames: quality profiling, log incidents, record transformation, document fields."""

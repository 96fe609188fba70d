"""Relational operators: DataFrames in, DataFrames out."""

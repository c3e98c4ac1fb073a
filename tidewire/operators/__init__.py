"""Relational operators: DataFrames and parameters in, DataFrames out."""

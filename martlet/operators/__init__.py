"""Operators: every function maps DataFrames (+ arguments) to a DataFrame."""

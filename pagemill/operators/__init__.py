"""Operators: every operator takes and returns DataFrames."""

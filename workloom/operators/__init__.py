"""Operators: each takes DataFrames and returns DataFrames, lazily unless its text says otherwise."""

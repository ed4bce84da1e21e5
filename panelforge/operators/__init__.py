"""Operators: each takes DataFrames and returns a DataFrame; nothing runs until an action does, unless a docstring says so."""

"""Operators: functions from DataFrames to DataFrames. None of them acts on data unless its docstring says so."""

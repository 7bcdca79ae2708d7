"""Operators on DataFrames: intervals, keys, changes, rules and admission."""

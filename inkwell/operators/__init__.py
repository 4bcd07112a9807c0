"""Relational operators: each takes and returns DataFrames and keeps no state of its own."""

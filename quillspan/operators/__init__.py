"""Relational operators and table changes on DataFrames."""

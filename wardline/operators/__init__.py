"""Relational operators over ranking data: each takes and returns DataFrames."""

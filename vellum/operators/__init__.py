"""Operators on DataFrames of queries, chunks, candidates and evaluation records."""

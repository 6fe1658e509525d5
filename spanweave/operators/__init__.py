"""Operators on DataFrames of spans, names and scores."""

"""Whole analyses built from operators, and the queries that run them on tables."""

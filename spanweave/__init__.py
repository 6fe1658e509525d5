"""Reconciliation of timed events on two timelines, as Spark DataFrame operators."""

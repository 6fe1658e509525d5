"""Readers of scripts, tracks and tables."""

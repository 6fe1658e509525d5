"""Streaming forms of the stores: an addition, as the batch operators poll snapshots."""

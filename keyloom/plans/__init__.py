"""Compaction policy and the catalog."""

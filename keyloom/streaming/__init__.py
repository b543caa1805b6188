"""Continuous ingestion of a mutation log."""

"""Scalar functions and byte codecs of keys, entries and batches."""

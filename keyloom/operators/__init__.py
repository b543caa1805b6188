"""Operators over the mutation log: sequences, state, runs, merges."""

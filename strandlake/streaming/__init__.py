"""Incremental forms of the batch aggregates."""

"""Readers and writers of the domain formats."""

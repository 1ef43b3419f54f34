"""Readers and writers of the raw files."""

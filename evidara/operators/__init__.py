"""Relational operators that Spark has no single name for."""

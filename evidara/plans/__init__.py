"""Composed queries: safety assessment, ranking, risk placeholder, reports, knowledge loading."""

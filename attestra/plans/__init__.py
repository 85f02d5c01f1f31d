"""Whole queries: rendered reports, evaluation and the query catalogue."""

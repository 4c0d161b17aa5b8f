"""Whole plans: the pipeline over files and the query catalogue."""

"""Comparison of report versions, and preparation of training text, as Spark jobs."""

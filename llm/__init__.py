"""Operators for large training-data corpora, written as Spark jobs."""

"""Corpus and benchmark analytics as Spark DataFrame pipelines."""

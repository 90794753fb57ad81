"""Corpus operators for training-data pipelines, each with one registered query."""

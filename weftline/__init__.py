"""Spark-native analytics over hyperlinked text corpora."""

__version__ = "0.1.0"

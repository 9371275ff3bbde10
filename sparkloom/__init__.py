"""Spark-native curation, evaluation and decision analytics."""

__version__ = "0.1.0"

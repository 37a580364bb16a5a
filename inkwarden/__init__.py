"""Spark-native text privacy, quality and corpus-preparation engine."""

__version__ = "0.1.0"

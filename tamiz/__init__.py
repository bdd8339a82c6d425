"""Spark-native engine for public-evidence analytics."""

__version__ = "0.1.0"

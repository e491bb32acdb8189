"""Spark-native lead-mail analytics."""

__version__ = "0.1.0"

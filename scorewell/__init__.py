"""Spark-native data work for binary classification on large tables and streams."""

__version__ = "0.1.0"

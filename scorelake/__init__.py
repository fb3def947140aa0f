"""Spark-native analytics for ordered discrete-event sequences."""

__version__ = "0.1.0"

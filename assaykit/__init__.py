"""Spark-native analytics for compound-screening tables."""

__version__ = "0.1.0"

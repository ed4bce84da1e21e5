"""Spark-native analytics for multi-asset panels and for cleaning the data they are built from."""

__version__ = "0.1.0"

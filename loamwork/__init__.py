"""Spark-native analytics over document catalogues, metric events and training text."""

__version__ = "0.1.0"

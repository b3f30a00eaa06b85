"""Gleanstone: a PySpark-native engine that turns request logs into evaluation sets."""

__version__ = "0.1.0"

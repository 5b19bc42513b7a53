"""Spark-native extractive condensation: long documents in, traceable shorter editions out."""

__version__ = "0.1.0"

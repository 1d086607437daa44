"""Spark-native text redaction, anonymisation and corpus preparation."""

__version__ = "0.1.0"

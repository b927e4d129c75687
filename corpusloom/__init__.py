"""Spark-native document-to-corpus engine."""

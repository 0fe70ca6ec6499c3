"""Spark-native engine for citation corpora."""

"""Spark-native engine for diachronic parallel corpora."""

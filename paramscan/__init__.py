"""Spark-native engine for datasets whose file names encode parameters."""

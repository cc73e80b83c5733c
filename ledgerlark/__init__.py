"""Spark-native analytics over registry-style records."""

"""Spark-native analytics for head-to-head competition data."""

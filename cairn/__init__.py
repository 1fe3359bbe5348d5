"""Spark-native analytics for static evidence, built on DataFrames and SQL."""

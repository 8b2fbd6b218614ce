"""Spark-native evaluation analytics: indexes, splits, vectors, metrics, resampling, inference and reports as DataFrames."""

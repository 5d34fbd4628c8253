"""Spark-native image decoding and metadata, as DataFrames."""

"""Spark-native context compression, content-addressed storage and retrieval over DataFrames."""

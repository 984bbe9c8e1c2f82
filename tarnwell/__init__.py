"""Spark-native analytics over source-code inventories and text corpora."""

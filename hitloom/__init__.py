"""Spark-native analytics for pixel-detector hits, clusters and tracks."""

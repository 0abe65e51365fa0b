"""Lorewell: a Spark-native engine for graph-based retrieval over text."""

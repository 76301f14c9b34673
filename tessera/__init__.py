"""Spark-native analytics for document-retrieval datasets."""

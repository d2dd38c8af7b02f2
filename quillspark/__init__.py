"""Spark-native retrieval and corpus curation."""

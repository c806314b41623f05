"""Spark-native retrieval, extraction and evidence analytics for research documents."""

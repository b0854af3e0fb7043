"""Spark-native analytics over face embeddings and photo metadata."""

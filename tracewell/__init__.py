"""Spark-native analytics over disk-image evidence and training-data corpora."""

"""Spark-native preparation of training corpora."""

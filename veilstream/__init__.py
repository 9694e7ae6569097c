"""Spark-native detection and handling of sensitive content in large text collections."""

"""Spark-native analytics for annotation, prediction and tracking tables."""

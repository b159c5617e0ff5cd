"""Spark-native snapshot analytics engine."""

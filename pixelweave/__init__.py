"""Spark-native analytics over ordered image sequences."""

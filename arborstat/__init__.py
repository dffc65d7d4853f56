"""Spark-native hierarchical effect discovery."""

"""Spark-native engine for public-accountability data."""

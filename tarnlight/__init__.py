"""Spark-native search and content analytics engine."""

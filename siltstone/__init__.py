"""Spark-native text analytics and hybrid retrieval."""

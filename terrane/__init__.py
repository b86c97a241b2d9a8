"""Spark-native analytics for an urban land market."""

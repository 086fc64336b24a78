"""Spark-native analytics over scored public performances."""

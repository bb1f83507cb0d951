"""Spark-native entity resolution: blocking, pair features, matching and validation as DataFrame operators."""

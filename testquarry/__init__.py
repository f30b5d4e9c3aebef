"""Spark-native analytics over UI-test event corpora."""

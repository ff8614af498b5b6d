"""Spark-native analytics over corpora of business documents."""

"""Spark-native document-layout analytics."""

"""A Spark-native engine for building, sanitizing and preparing text records."""

"""Tidewire: a Spark-native engine for news-intelligence analytics."""

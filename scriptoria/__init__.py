"""Scriptoria: a Spark-native engine for scholarly libraries."""

"""Spark-native analytics for recommending and auditing procedure codes."""

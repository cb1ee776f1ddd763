"""Spark-native analytics for application-security review data."""

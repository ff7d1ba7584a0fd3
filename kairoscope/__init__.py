"""Spark-native moment retrieval, fact graphs and evidence assembly over time-coded media."""

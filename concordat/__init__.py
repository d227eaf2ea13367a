"""Spark-native reconciliation of two tables."""

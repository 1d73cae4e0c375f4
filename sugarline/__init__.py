"""Glucose time-series analytics as Spark DataFrame operations."""

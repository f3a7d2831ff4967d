"""Spark-first recommendation and record-quality analytics."""

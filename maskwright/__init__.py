"""Sensitive-content detection and replacement, and training-data preparation, on Spark."""

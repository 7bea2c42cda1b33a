"""Tidemark: keyed daily time series and training-data preparation on Spark."""

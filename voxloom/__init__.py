"""Sparse-spatial analytics on Spark."""

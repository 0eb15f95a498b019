"""Sparse-matrix analytics, label-tree ranking and retrieval on Spark DataFrames."""

"""Versioned columnar datasets with vectors, on Spark DataFrames."""

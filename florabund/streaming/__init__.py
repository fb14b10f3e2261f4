"""Additive operators on streaming DataFrames."""

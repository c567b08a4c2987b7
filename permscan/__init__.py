"""Permutation-based association analytics on Spark DataFrames."""

"""Grounded-claims analytics on Spark DataFrames."""

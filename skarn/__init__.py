"""Skarn: table contracts, drift, scoring and model analytics on Spark DataFrames."""

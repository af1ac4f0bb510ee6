"""Palimpsest: document reconstruction and corpus preparation on Spark DataFrames."""

"""Temporal-containment analytics on Spark DataFrames."""

"""Rare-event analytics on Spark DataFrames."""

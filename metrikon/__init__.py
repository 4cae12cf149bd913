"""Measurement analytics on Spark DataFrames."""

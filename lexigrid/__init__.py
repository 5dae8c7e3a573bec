"""Multilingual document analytics on Spark DataFrames."""

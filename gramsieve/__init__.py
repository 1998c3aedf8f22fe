"""Regex search and n-gram analytics on Spark DataFrames."""

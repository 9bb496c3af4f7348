"""Veritally: result-verification analytics on Spark DataFrames."""

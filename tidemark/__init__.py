"""Declarative, leak-proof data preparation and analytics on Spark DataFrames."""

"""Ledgerscope: evidence-backed company analytics on Spark DataFrames."""

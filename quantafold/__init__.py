"""Quantafold: document-metrics analytics on Spark DataFrames."""

"""Compression, archive and corpus analytics on Spark DataFrames."""

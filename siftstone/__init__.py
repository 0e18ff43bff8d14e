"""Findings about source files, computed as Spark DataFrames."""

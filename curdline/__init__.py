"""Screening analytics over collection records, expressed as Spark DataFrames."""

"""Semantic-reuse analytics on Spark: evidence layers, retrieval, ingestion, maintenance and usage as DataFrames."""

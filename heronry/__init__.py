"""Extraction, evidence, state and reporting operators for web-page metadata, on Spark DataFrames."""

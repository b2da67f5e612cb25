"""Tidewright: semi-structured data pipelines on Spark DataFrames."""

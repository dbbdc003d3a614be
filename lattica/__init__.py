"""A data-processing library on PySpark DataFrames, SQL and Structured Streaming."""

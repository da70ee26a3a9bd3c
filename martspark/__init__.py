"""Retail analytics jobs written as PySpark DataFrame and Structured Streaming plans."""

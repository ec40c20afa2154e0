"""Quirework: book-scale document processing on DataFrames, SQL and Catalyst."""

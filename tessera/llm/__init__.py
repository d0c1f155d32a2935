"""Operators of a large-scale training-data pipeline over a table of documents."""

"""Operators for large text corpora (training-data preparation).

Each module holds one operator with a general DataFrame interface and the thin
query that applies it to the driver's tables; ``queries.py`` is the registry.
"""

"""Operators of a training-data pipeline: text, near copies, tokens, embeddings.

The operators take and return DataFrames.  ``queries`` registers one query for each of them.
Nothing outside this subpackage imports it.
"""

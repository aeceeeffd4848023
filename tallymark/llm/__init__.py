"""Operators of a training-data pipeline over documents, embeddings and labels.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns a DataFrame; ``queries`` holds the thin ``opN_*`` wrappers.
"""

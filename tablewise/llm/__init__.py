"""Operators of a training-data pipeline over a table of documents.

Every operator takes a DataFrame and returns a DataFrame; the columns it needs are named by arguments, other
columns are neither read nor returned. Nothing else in the library imports this subpackage.
"""

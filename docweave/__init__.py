"""Reconciling, validating and curating records read from many documents, on Spark DataFrames."""

"""Operators for large training-corpus pipelines.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when the subpackage is present.
"""

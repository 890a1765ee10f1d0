"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and :mod:`corpus_pipeline` at the repository top chains five of them.
"""

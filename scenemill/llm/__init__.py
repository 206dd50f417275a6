"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Every operator takes a
``DataFrame`` and column names and returns a ``DataFrame``; ``queries`` holds the
thin registered queries.
"""

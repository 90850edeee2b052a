"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  ``registry`` holds the queries and
their SQL.
"""

"""Operators for preparing language-model training corpora.

Every module holds one operator with a general interface and the thin query
that applies it to a whole table.  Nothing outside this package imports it.
"""

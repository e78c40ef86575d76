"""Operators for building training corpora.

Nothing outside this subpackage imports it.  ``queries.py`` registers one
query per operator; every operator has its own module with a general
interface and its own docstring on nulls, empty tables and ties.
"""

"""Operators for large training-data corpora.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""

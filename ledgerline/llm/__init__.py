"""Operators of a training-data pipeline: one module each, queries in ``queries.py``.

Nothing else in the library imports this subpackage.
"""

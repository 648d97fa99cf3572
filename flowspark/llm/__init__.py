"""Operators of a training-data pipeline and the queries that apply them to the test tables.

Nothing else in the library imports this subpackage.
"""

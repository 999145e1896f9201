"""Operators that a large training-data pipeline needs, one module each.

Nothing else in the library imports this subpackage.
"""

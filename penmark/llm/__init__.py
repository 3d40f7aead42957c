"""Operators for preparing training data, one module per operator.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  ``queries`` registers one query per operator.
"""

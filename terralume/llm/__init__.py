"""Operators for large text, vector and URL tables used to prepare training data.

Nothing outside this subpackage imports it.
"""

"""Operators for large training-text corpora, one module each.

Nothing else in the library imports this subpackage.
"""

"""Operators for building training data from a corpus, ten of them, one module each.

Nothing outside this subpackage imports it.
"""

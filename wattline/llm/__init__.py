"""Operators for preparing training text and vectors.  Nothing outside this subpackage imports it."""

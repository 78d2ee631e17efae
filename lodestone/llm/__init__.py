"""Operators for large text-corpus preparation; nothing else in the library imports this package."""

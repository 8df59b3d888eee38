"""Operators for building large training corpora. Nothing else in the library imports this package."""

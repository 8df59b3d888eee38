"""Readers, writers and feed parsers."""

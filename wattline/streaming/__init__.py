"""Structured Streaming versions of the rollup, dedupe, upsert, position and log steps."""

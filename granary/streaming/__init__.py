"""Incremental work as Structured Streaming queries, with the same rules as batch functions."""

"""Structured Streaming: incremental work on files that arrive."""

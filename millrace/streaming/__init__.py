"""Structured Streaming twins of the trace and progress operators."""

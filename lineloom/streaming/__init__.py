"""Structured Streaming forms of the intake operators."""

"""Structured Streaming forms of the log, request and rate-limit operators."""

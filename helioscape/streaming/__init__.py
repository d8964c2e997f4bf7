"""Structured Streaming forms of the request service."""

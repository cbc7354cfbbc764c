"""Structured Streaming around index maintenance."""

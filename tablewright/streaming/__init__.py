"""Streaming of the table engine."""

"""Operators of the table engine."""

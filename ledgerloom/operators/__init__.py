"""Operators over change logs and event tables."""

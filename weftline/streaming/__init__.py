"""Streaming of the style-audit engine."""

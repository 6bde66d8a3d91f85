"""Drift of streams."""

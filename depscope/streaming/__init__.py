"""Maintaining dependency counts over a stream."""

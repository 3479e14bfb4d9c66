"""Crowd reports as streams."""

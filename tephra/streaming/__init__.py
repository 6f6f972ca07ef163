"""Writes that arrive as streams."""

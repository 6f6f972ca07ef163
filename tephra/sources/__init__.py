"""Stored tables, file formats and generators."""

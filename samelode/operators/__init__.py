"""Operators on files, extents and blocks."""

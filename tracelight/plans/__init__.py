"""Texts of the three dialects, read into plain data."""

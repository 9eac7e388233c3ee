"""Operators over modes, points and series."""

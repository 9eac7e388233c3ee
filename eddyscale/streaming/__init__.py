"""Diagnostics over arriving snapshots."""

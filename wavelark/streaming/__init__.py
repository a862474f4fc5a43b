"""Streams of change rows."""

"""Regions that arrive as a stream."""

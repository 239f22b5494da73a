"""Readers and writers of the formats around a projection."""

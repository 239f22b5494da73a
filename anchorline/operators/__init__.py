"""Relational operators on blocks, points, hops and routes."""

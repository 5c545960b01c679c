"""Readers. Each takes a path or passes a DataFrame through."""

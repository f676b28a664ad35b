"""Relational operators over atlas tables."""

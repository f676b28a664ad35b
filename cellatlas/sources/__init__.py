"""Readers and writers of atlas tables."""

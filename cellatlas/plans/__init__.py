"""Queries over the local star schema, with their SQL."""

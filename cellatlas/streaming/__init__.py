"""Incremental forms of atlas operators."""

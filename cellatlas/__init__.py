"""Cluster-level analytics of annotated cell atlases, as DataFrame operators."""
